"""Exclusion patterns as a table: any number of regular expressions against any number of urls.

A pattern can only hit a url that holds the plain text which the pattern asks for. Of every pattern the runs of
characters it requires are read off once; one of their n-grams, the one that fewest urls hold, is the pattern's
key. Urls meet patterns in a join on their n-grams, and a regular expression is only run on pairs that met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators.joins import hot_keys, salted_join
from pageloom.session import cut_lineage

# Characters of a key; a pattern that only requires shorter runs has a shorter key.
GRAM = 4
# Patterns that require no text are tried on every url, so there can only be so many of them.
MOST_OPEN = 1000


def required_runs(pattern: str) -> list[str]:
    """Runs of characters that every match holds; none where that cannot be told."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    runs, run = [], ""

    def end() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                end()
                walk(value[2])
                end()
            else:
                end()

    walk(parsed)
    end()
    return runs


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, gram): for every pattern the n-grams it requires, of the longest size it has; '' where it has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for pattern in batch.column("pattern").to_pylist():
                runs = required_runs(pattern)
                size = min(GRAM, max(map(len, runs), default=0))
                grams = {run[k : k + size] for run in runs for k in range(len(run) - size + 1)} if size else {""}
                for gram in sorted(grams):
                    out[0].append(pattern)
                    out[1].append(gram)
            yield pa.record_batch({"pattern": pa.array(out[0], pa.string()), "gram": pa.array(out[1], pa.string())})

    distinct = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    return distinct.mapInArrow(work, "pattern string, gram string")


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))


def excluded_by_table(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add ``is_excluded``: whether any of the patterns is found in ``url``. A null url is not excluded.

    The result is that of all patterns joined by ``|``. Keys are chosen by how many urls hold them, so a text
    that most urls hold, as their scheme, is no key unless a pattern requires nothing else; the urls of such a
    key are split. Patterns must be read alike by Java, which runs them, and Python, which reads their plain
    text; what Python cannot read counts as requiring nothing.
    """
    grams = cut_lineage(pattern_grams(patterns))
    needy = grams.where("gram = ''").select("pattern").limit(MOST_OPEN + 1).collect()
    if len(needy) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} patterns require no text")
    keyed = grams.where("gram <> ''")
    wanted = keyed.select("gram").distinct()
    sizes = [r[0] for r in keyed.select(F.length("gram")).distinct().collect()]  # at most GRAM numbers
    url = F.col("url")
    cuts = [_grams(url, n) for n in sizes]
    held = rows.select("url").where(url.isNotNull()).distinct()
    every = F.concat(*cuts) if cuts else F.array().cast("array<string>")
    held = held.select("url", F.explode(F.array_distinct(every)).alias("gram"))
    held = cut_lineage(held.join(wanted, "gram", "left_semi"))
    count = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A pattern with a gram that no url holds cannot hit.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
    chosen = keyed.join(count, "gram", "left").groupBy("pattern").agg(rarest.alias("key")).where("key.n > 0")
    chosen = chosen.select("pattern", F.col("key.gram").alias("gram"))
    of_key = chosen.groupBy("gram").agg(F.collect_list("pattern").alias("patterns"))
    met = salted_join(held, of_key, ["gram"], hot_keys(held, ["gram"]), F.col("url"), "inner")
    hits = met.where(F.exists("patterns", lambda p: F.rlike(F.col("url"), p))).select("url").distinct()
    joined = rows.join(hits.withColumn("__hit", F.lit(True)), "url", "left")
    open_hit = urls.matches_any(url, [r["pattern"] for r in needy]) if needy else F.lit(False)
    hit = F.coalesce("__hit", F.lit(False)) | F.coalesce(open_hit, F.lit(False))
    return joined.select(*rows.columns, hit.alias("is_excluded"))
