"""The stored collections: named tables and versioned snapshots.

A snapshot is a new folder every time, so a job can read the state it replaces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COLLECTIONS = ("pages", "scraping_jobs", "url_queue", "site_structure")

# Columns rows are clustered by on write. Range partitioning splits a large
# section or job over several files, and the row-group min/max of each file
# prune reads that filter on these columns.
CLUSTER_BY = {
    "pages": ("navigation.section", "navigation.subsection", "url"),
    "url_queue": ("job_id", "status", "priority"),
    "scraping_jobs": ("start_time",),
    "site_structure": ("domain",),
}


def clustered(df: DataFrame, collection: str, files: int) -> DataFrame:
    columns = CLUSTER_BY[collection]
    return df.repartitionByRange(files, *columns).sortWithinPartitions(*columns)


def save_table(df: DataFrame, collection: str, files: int, database: str = "default") -> str:
    """Write a collection as a named table."""
    name = f"{database}.{collection}"
    clustered(df, collection, files).write.mode("overwrite").saveAsTable(name)
    return name


def load_table(spark: SparkSession, collection: str, database: str = "default") -> DataFrame:
    return spark.read.table(f"{database}.{collection}")


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots below ``root``, oldest first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        match = re.fullmatch(r"snapshot-(\d+)", status.getPath().getName())
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if match and fs.exists(done):
            found.append(int(match.group(1)))
    return sorted(found)


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write the next state of a collection; readers see it once it is complete."""
    done = _snapshots(df.sparkSession, root)
    path = f"{root}/snapshot-{(done[-1] + 1) if done else 1:08d}"
    # An unfinished folder of that number, left by a failed write, is replaced.
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    done = _snapshots(spark, root)
    if not done:
        raise FileNotFoundError(f"no complete snapshot in {root}")
    return spark.read.parquet(f"{root}/snapshot-{done[-1]:08d}")
