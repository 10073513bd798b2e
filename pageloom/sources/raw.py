"""Fetched responses as batch or streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom import schemas


def read_raw_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.RAW_PAGES).format(fmt).load(path)


def stream_raw_pages(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.RAW_PAGES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain file scan at least one partition per core.

    Input with few, unsplittable files would parse on a few cores. A scan that
    already has enough partitions, as any large table has, is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
