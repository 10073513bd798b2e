"""Exact line dedup across documents with levelled sorted runs, in DataFrame functions only.

A *run* is a table of line hashes with the smallest document holding each line, bucketed and sorted by
hash. Batches of documents come in ascending doc_id. Each batch aggregates its own lines to one row per
hash and merge-anti-joins them with every run, so only lines never seen before are left; those become a
new run. When a level holds ``fanout`` runs they are compacted into one run of the next level. Together
the runs hold each line once, with the document that keeps it. Buckets make the joins with runs merges
of sorted files: only the batch is shuffled.

A line is then dropped when its document is not the one in the runs. That test joins on hash and document,
so a line found in a third of all documents is spread like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Batches of a whole table and runs of a level; both are parameters of the operator.
BATCHES = 4
FANOUT = 2


def folded(text: Column) -> Column:
    """The text with A-Z in lower case; plain ASCII takes the faster function, which does the same there."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, text hash, line position and key hashes of each line with a key of ``least`` code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(folded("text"), "\n", -1)))
    key = F.btrim("col", F.lit(WHITE))
    return (
        lines.select("doc_id", "t", F.col("pos"), key.alias("key"))
        .where(F.length("key") >= least)
        .select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


class Runs:
    """The runs of all levels, as bucketed tables in the shared folder."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int) -> None:
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2")
        writer.sortBy("h1", "h2").option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.scratch.spark.table(name) for level in self.levels for name in level]

    def unseen(self, heads: DataFrame) -> DataFrame:
        """The rows of ``heads`` whose line is in no run."""
        heads = heads.repartition(self.buckets, "h1", "h2")
        for run in self.tables():
            heads = heads.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return heads

    def add(self, heads: DataFrame) -> None:
        """Write a new run, and compact the levels that are then full."""
        name, level = self._write(heads), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            rows = self.scratch.spark.table(old[0])
            for other in old[1:]:
                rows = rows.union(self.scratch.spark.table(other))
            name = self._write(rows)
            for table in old:
                self._forget(table)
            level += 1

    def _forget(self, name: str) -> None:
        self.scratch.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)

    def rows(self) -> DataFrame:
        """All runs as one plain table; the catalog forgets their names."""
        names = [name for level in self.levels for name in level]
        spark = self.scratch.spark  # a run without rows has no file, so schemas are given
        frames = [spark.read.schema(spark.table(name).schema).parquet(self.scratch.path(name)) for name in names]
        for name in names:
            spark.sql(f"DROP TABLE {name}")  # external: the files stay
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.union(frame)
        return rows


def dedup_lines(
    docs: DataFrame,
    scratch: Scratch,
    least: int = 10,
    batches: int = BATCHES,
    buckets: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` with the text without lines that an earlier document holds.

    Lines are what \\n separates; a null or empty text is one empty line. A line's key is the line without
    white space at its ends, A-Z folded. A key of at least ``least`` code points that is in several
    documents keeps all its lines in the smallest doc_id and loses them in all others. The rest is joined
    by \\n. Adds ``n_lines`` (before) and ``n_dropped``; other columns stay as they are, whatever their
    names, but columns of these two names are replaced.

    A null text stays null when nothing is dropped. Rows with the same doc_id are one document: they keep
    each other's lines. Rows without doc_id lose no line and take none from others. An empty table gives an
    empty one. Runs have as many ``buckets`` as the session has shuffle partitions unless told otherwise, so
    that each task writes one file.
    """
    buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    cuts = [k / batches for k in range(1, batches)]
    edges = keyed.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or []
    batch = sum((F.col("doc_id") > edge).cast("int") for edge in edges) if edges else F.lit(0)
    lines = scratch.save(line_keys(keyed, least).withColumn("batch", batch), "lines")
    runs = Runs(scratch, buckets, fanout)
    for k in range(len(edges) + 1):
        own = lines.where(F.col("batch") == k).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        runs.add(runs.unseen(own))
    kept = runs.rows().select("doc_id", "h1", "h2")

    parts = lines.select("doc_id", "t", "pos", "h1", "h2").repartition("doc_id")
    lost = parts.join(kept.repartition("doc_id"), ["doc_id", "h1", "h2"], "left_anti")
    drops = lost.groupBy("doc_id", "t").agg(F.collect_list("pos").alias("__drop"))
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "__drop")

    found = docs.join(drops, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t")), "left")
    pieces = F.split(docs["text"], "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__drop"))
    text = F.array_join(F.transform(stay, lambda k: F.element_at(F.col("__lines"), k + 1)), "\n")
    out = found.withColumn("__lines", F.when(F.col("__drop").isNotNull(), pieces))
    n_lines = F.coalesce(F.length(docs["text"]) - F.length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1, F.lit(1))
    out = out.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_dropped": F.coalesce(F.size(F.array_distinct("__drop")), F.lit(0)).cast("long"),
            "text": F.when(F.col("__drop").isNull(), docs["text"]).otherwise(text),
        }
    )
    return out.drop("__id", "__t", "__drop", "__lines")
