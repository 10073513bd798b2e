"""A stored crawl closure: what the seeds reach, kept so that later links only cost what they reach.

Links lie in a table bucketed by the node they leave, reached nodes in one bucketed by node. A round joins a
frontier with either table and moves the frontier alone: the tables are read where they lie. A frontier of few
nodes names them in the filter, so only their buckets and row groups are read. The links of a node with very
many lie under several keys, dealt by target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.joins import HOT_ROWS, SALTS
from pageloom.session import cut_lineage, shared_dir
from pageloom.sources.files import Folder

# A frontier of up to so many nodes is named in the filter.
FEW = 500
DEFAULT_BUCKETS = 32


def _key(node: str, slot: Column) -> Column:
    """Where links of a node lie; what stands before the first colon is a slot, or nothing."""
    return F.concat(slot, F.lit(":"), F.col(node).cast("string"))


class StoredClosure:
    def __init__(self, spark: SparkSession, max_depth: int | None = None, buckets: int = DEFAULT_BUCKETS) -> None:
        self.spark, self.max_depth, self.buckets = spark, max_depth, buckets
        self.name = f"closure_{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.name}"
        self.hot: DataFrame | None = None

    def _append(self, rows: DataFrame, table: str, key: str) -> None:
        """Add rows to a bucketed table; a task writes one bucket."""
        writer = rows.repartition(self.buckets, key).sortWithinPartitions(key).write.mode("append")
        writer = writer.bucketBy(self.buckets, key).sortBy(key).format("parquet")
        writer.option("path", f"{self.root}/{table}").saveAsTable(f"{self.name}_{table}")

    def _has(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_{table}")

    def _table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _near(self, table: str, key: str, frontier: DataFrame, size: int) -> DataFrame:
        """Rows of a table that a frontier's keys may meet."""
        rows = self._table(table)
        if size <= FEW:
            return rows.where(F.col(key).isin([r[0] for r in frontier.select(key).distinct().collect()]))
        return rows

    def reached(self) -> DataFrame:
        """Every reached node with its first depth."""
        return self._table("reached").groupBy("node").agg(F.min("depth").alias("depth"))

    def add(self, edges: DataFrame, seeds: DataFrame | None = None) -> int:
        """Take in more links and seeds and walk on; gives the number of rounds.

        A node that was reached is reached at a smaller depth if the new links are a shorter way.
        """
        links = cut_lineage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
        if self.hot is None:
            many = links.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
            self.hot = cut_lineage(many.select(F.col("src").alias("hot_node")))
        marked = links.join(self.hot, F.col("src") == F.col("hot_node"), "left")
        slot = F.when(F.col("hot_node").isNotNull(), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("string")).otherwise("")
        self._append(marked.select(_key("src", slot).alias("key"), "src", "dst"), "links", "key")
        candidates = None
        if seeds is not None:
            candidates = seeds.select("node", F.lit(0).alias("depth"))
        if self._has("reached"):
            sources = self.reached().join(links.select("src").distinct(), F.col("node") == F.col("src"), "left_semi")
            onward = sources.join(links, F.col("node") == F.col("src"))
            further = self._limited(onward.select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")))
            candidates = further if candidates is None else candidates.unionAll(further)
        rounds = 0
        while candidates is not None:
            level, size = self._improved(candidates)
            if not size:
                break
            rounds += 1
            self._append(level, "reached", "node")
            candidates = self._limited(self._targets(level, size))
        return rounds

    def _limited(self, rows: DataFrame) -> DataFrame:
        return rows if self.max_depth is None else rows.where(F.col("depth") <= self.max_depth)

    def _improved(self, candidates: DataFrame) -> tuple[DataFrame, int]:
        """Candidates that are new or nearer than known, written down, and their number."""
        nearest = candidates.groupBy("node").agg(F.min("depth").alias("depth"))
        if not self._has("reached"):
            level = cut_lineage(nearest)
            return level, level.count()
        nearest = cut_lineage(nearest)
        known = self._near("reached", "node", nearest, nearest.count())
        known = known.groupBy(F.col("node").alias("known")).agg(F.min("depth").alias("least"))
        joined = nearest.join(known, F.col("node") == F.col("known"), "left")
        nearer = F.col("known").isNull() | (F.col("depth") < F.col("least"))
        level = cut_lineage(joined.where(nearer).select("node", "depth"))
        return level, level.count()

    def _targets(self, level: DataFrame, size: int) -> DataFrame:
        """Where the links of a level lead, one deeper."""
        marked = level.join(self.hot, F.col("node") == F.col("hot_node"), "left")
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<string>")
        slots = F.when(F.col("hot_node").isNotNull(), salts).otherwise(F.array(F.lit("")))
        # Links that came before a node was known to be hot lie under its plain key.
        slots = F.array_union(slots, F.array(F.lit("")))
        keyed = marked.withColumn("slot", F.explode(slots)).select("depth", _key("node", F.col("slot")).alias("key"))
        # The key is all that is joined on, as the table is bucketed by it.
        joined = self._near("links", "key", keyed, size).join(keyed, "key")
        return joined.select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    def drop(self) -> None:
        """Remove both tables and their files."""
        for table in ("links", "reached"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
        Folder(self.spark, shared_dir(self.spark)).delete(self.name)
