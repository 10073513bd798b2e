"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target number of words. It is taken whole as often as it fits; the remaining budget is
smaller than the source and is filled by choosing *how many documents of each exact length* are taken once
more: a proportional share of every length first, rounded by largest remainder with a seeded hash between equal
ones, then a bounded-knapsack dynamic program for the few words still missing. Documents are chosen by a seeded
hash within their length.

Only counts by (source, length) meet in one place, never documents: a histogram has at most as many
entries as there are different lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch
from pageloom.llm.textops import mix

# No document is taken more often.
MOST = 3
WEIGHTS = (1, 2, 3)
# Documents of a (source, length) group are ranked in so many slices by hash.
SLICES = 64
# The dynamic program takes over when so many words are missing; before, shares are rounded up one by one.
KNAPSACK = 1 << 12


def words_of(text: str) -> Column:
    """Number of words in a column of texts."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target, from one row of ``sizes(source, source_size)`` per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. No
    target passes ``most`` times its source's size; what is over goes to the others by weight. So a target
    is min(most * size, weight * level) for the one level at which the targets add up: sources are filled in
    the order of most * size / weight, and the level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    rows = weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, heavy = F.sum("source_size").over(whole), F.sum("w").over(whole)
    left = total - F.coalesce(F.sum("cap").over(so_far), F.lit(0))
    level = left / (heavy - F.coalesce(F.sum("w").over(so_far), F.lit(0)))
    rows = rows.withColumn("level", level)
    # The first source whose cap is not reached fixes the level of all after it.
    below = F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))
    first = F.min(below).over(whole)["level"]
    final = F.coalesce(F.least(F.col("w") * first, F.col("cap")), F.col("cap"))
    return rows.select("source", "source_size", final.cast("double").alias("target"))


def turns(lengths: np.ndarray, seed: int) -> np.ndarray:
    """A seeded order of lengths, the same wherever it is worked out."""
    return mix(mix(lengths.astype(np.uint64)) ^ np.uint64(seed % (1 << 64)))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 7, limit: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that the words come as near to ``budget`` as can be.

    Every length has its proportional share, long and short ones alike: what rounding down leaves is given out
    by largest remainder, equal remainders (as all lengths that one document has) in a seeded order, until so
    little is missing that the program can find the best sum. The same counts give the same choice.
    """
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    exact = [int(c) * budget for c in counts]  # whole numbers of any size
    share = np.array([e // max(whole, 1) for e in exact], dtype=np.int64)
    left = int(budget - (lengths * share).sum())
    spare = counts - share
    remainder = np.array([e % max(whole, 1) / max(whole, 1) for e in exact])
    order = np.lexsort((turns(lengths, seed), -remainder))
    while left >= limit:
        before = left
        for k in order:
            if left < limit:
                break
            if spare[k] and 0 < lengths[k] <= left:
                share[k] += 1
                spare[k] -= 1
                left -= int(lengths[k])
        if left == before:  # what is spare is longer than what is missing
            break
    usable = np.flatnonzero((spare > 0) & (lengths > 0) & (lengths <= 2 * max(left, 1)))
    usable = usable[np.argsort(turns(lengths[usable], seed + 1), kind="stable")]
    room = 2 * left  # a sum just over the budget may be nearer than any below
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for k in usable:
        have, power = int(min(spare[k], room // lengths[k])), 1
        while have > 0:  # bounded counts as powers of two
            n = min(power, have)
            after = (reached | reached << (n * int(lengths[k]))) & mask
            if after != reached:
                steps.append((int(k), n, reached))
                reached = after
            have, power = have - n, power * 2
        if reached >> left & 1 and len(steps) > 64:
            break
    for off in range(left + 1):
        below, above = left - off, left + off
        if reached >> below & 1 or reached >> above & 1:
            at = below if reached >> below & 1 else above
            break
    for k, n, before in reversed(steps):
        if not before >> at & 1:
            share[k] += n
            at -= n * int(lengths[k])
    return share


def mix_sources(
    docs: DataFrame, scratch: Scratch, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size * copies) of every document.

    Size is the number of words; a null text has none. A null source is a source of its own, last. Rows are
    chosen by a seeded hash of doc_id and size, then by doc_id; a null doc_id comes first. Documents without
    words are taken as often as the whole source and count nothing. Repeated rows are single documents; of
    equal ones any may be taken, the sum is the same. An empty table gives an empty one; other columns are
    not looked at.
    """
    sized = docs.select("doc_id", "source", words_of("text").alias("size"))
    rank = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = scratch.save(sized.withColumns({"rank": rank, "slice": F.pmod(rank, F.lit(SLICES))}), "sizes")
    counts = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = scratch.save(targets(sizes, weights, most), "targets")

    def allot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(most, int(target // total)) if total else 1
        left = 0 if whole == most else int(round(target - whole * total))
        chosen = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), left, seed)
        return pdf.assign(base=whole, extra=chosen)[["source", "size", "base", "extra", "source_size", "target"]]

    same = F.col("l.source").eqNullSafe(F.col("g.source"))
    joined = lengths.alias("l").join(goal.alias("g"), same).select("l.*", "g.source_size", "g.target")
    quota = joined.groupBy("source").applyInPandas(
        allot, "source string, size long, base long, extra long, source_size long, target double"
    )
    quota = scratch.save(quota, "quota")
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    s, q = start.alias("s"), quota.alias("q")
    per_slice = s.join(
        q, F.col("s.source").eqNullSafe(F.col("q.source")) & (F.col("s.size") == F.col("q.size"))
    ).select(
        "s.source", "s.size", "s.slice", "base", "source_size", "target", (F.col("extra") - F.col("start")).alias("take")
    )
    r, p = rows.alias("r"), per_slice.alias("p")
    on = (
        F.col("r.source").eqNullSafe(F.col("p.source"))
        & (F.col("r.size") == F.col("p.size"))
        & (F.col("r.slice") == F.col("p.slice"))
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("rank", "doc_id"))
    out = r.join(p, on).select("r.*", "base", "source_size", "target", "take").withColumn("place", place)
    copies = F.col("base") + (F.col("place") <= F.col("take")).cast("long")
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def mixed_documents(docs: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns as they are.

    Rows that share doc_id, source and size share their copies evenly, rounded up.
    """
    mix = mix_sources(docs, scratch, seed).groupBy("doc_id", "source", "size")
    mix = mix.agg(F.sum("copies").alias("__n"), F.count("*").alias("__of"))
    mix = mix.select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        F.col("size").alias("__size"),
        F.ceil(F.col("__n") / F.col("__of")).cast("int").alias("__copies"),
    )
    sized = docs.withColumn("__words", words_of("text"))
    on = (
        sized["doc_id"].eqNullSafe(F.col("__id"))
        & sized["source"].eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    rows = sized.join(mix.where("__copies > 0"), on)
    return rows.withColumn("__turn", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
