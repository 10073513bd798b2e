"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for every node of ``links(a, b)``.

    Alternates the large-star and small-star steps: each round points the neighbours of a node at the
    smallest of them, until every node points at its component's smallest one. A node with very many
    neighbours is only ever reduced to a minimum and joined back, never gathered. Rounds grow with the
    logarithm of the longest chain; each is written to the shared folder, so a lost executor costs one.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = scratch.save(links.where("a <> b").select(u, v).distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        stars = scratch.save(small, f"{name}-{step}")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        scratch.drop(f"{name}-{step - 1}")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
