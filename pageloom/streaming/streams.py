"""The crawl loops as Structured Streaming queries.

What a loop must remember of earlier batches is keyed state in the state store: of a page its hash, version and
first sight, of a queued url that it is known. So a batch costs what its own keys cost, however long the crawl has
run, and nothing that earlier batches wrote is read again. Rows travel past the state as JSON, which holds every
column whatever its type; the state itself is a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.functions import urls
from pageloom.operators.dedup import HASH
from pageloom.operators.extract import extract_pages
from pageloom.operators.jobs import job_statistics
from pageloom.sources.files import Folder

BATCH = "batch_id"
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _write_batches(folder: str, unpack: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Each batch in its own folder; a batch that is replayed overwrites it."""

    def write(rows: DataFrame, batch_id: int) -> None:
        unpack(rows).write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")

    return write


def _started(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    stream = rows.writeStream.outputMode(mode).foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_versions(pages: DataFrame) -> DataFrame:
    """New and changed pages of a stream as (url, version, first_seen, page), the page in JSON.

    Of several rows of a url in one batch the newest counts, content hash as tie-break.
    """

    def next_version(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in frames:
            for row in zip(frame["seen"], frame["hash"], frame["page"], strict=True):
                if newest is None or row[:2] > newest[:2]:
                    newest = row
        seen, digest, page = newest
        known, version, first_seen = state.get if state.exists else (None, 0, seen)
        if digest != known:
            state.update((digest, version + 1, first_seen))
            yield pd.DataFrame({"url": [key[0]], "version": [version + 1], "first_seen": [first_seen], "page": [page]})

    packed = pages.select(
        "url",
        F.unix_micros("metadata.scraped_at").alias("seen"),
        F.col(HASH).alias("hash"),
        F.to_json(F.struct(*pages.columns), _EXACT).alias("page"),
    )
    return packed.groupBy("url").applyInPandasWithState(
        next_version,
        "url string, version int, first_seen long, page string",
        "hash string, version int, first_seen long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def ingest_pages(raw: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Continuous ingest: responses to pages to the page version log, which only grows by what is new or changed."""
    pages = extract_pages(raw)
    schema = pages.schema

    def unpacked(rows: DataFrame) -> DataFrame:
        page = F.from_json("page", schema, _EXACT)
        first = F.timestamp_micros("first_seen")
        return rows.select("version", "first_seen", page.alias("page")).select(
            *[
                F.col("version").alias(name)
                if name == "version"
                else F.col("page.metadata").withField("scraped_at", first).alias(name)
                if name == "metadata"
                else F.col(f"page.{name}").alias(name)
                for name in schema.names
            ]
        )

    return _started(page_versions(pages), _write_batches(log_path, unpacked), checkpoint)


def current_pages(spark: SparkSession, log_path: str) -> DataFrame:
    """The stored pages: the newest version of every url in the log."""
    log = spark.read.parquet(log_path)
    newest = log.groupBy("url").agg(F.max("version").alias("version"))
    return log.join(newest, ["url", "version"], "left_semi").drop(BATCH)


def frontier_within(candidates: DataFrame, delay: str = "1 day") -> DataFrame:
    """First sight of each (job, url) while the watermark remembers it."""
    return (
        candidates.withColumn("normalized_url", urls.normalize_url(F.col("url")))
        .withWatermark("discovered_at", delay)
        .dropDuplicatesWithinWatermark(["job_id", "normalized_url"])
    )


def ingest_frontier_within(
    candidates: DataFrame, queue_path: str, checkpoint: str, delay: str = "1 day"
) -> StreamingQuery:
    """``frontier_within`` to a folder: state is bounded by the watermark, keys may come again after it."""
    return (
        frontier_within(candidates, delay)
        .writeStream.format("parquet")
        .option("path", queue_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def first_sights(candidates: DataFrame) -> DataFrame:
    """Exact dedup of a stream: (job_id, normalized_url, row) of every key that no earlier batch had.

    Within a batch the earliest candidate counts, then the one whose row in JSON is least.
    """

    def first_sight(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        earliest = min(row for frame in frames for row in zip(frame["seen"], frame["row"], strict=True))
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({"job_id": [key[0]], "normalized_url": [key[1]], "row": [earliest[1]]})

    packed = candidates.select(
        "job_id",
        urls.normalize_url(F.col("url")).alias("normalized_url"),
        F.unix_micros("discovered_at").alias("seen"),
        F.to_json(F.struct(*candidates.columns), _EXACT).alias("row"),
    )
    return packed.groupBy("job_id", "normalized_url").applyInPandasWithState(
        first_sight,
        "job_id string, normalized_url string, row string",
        "known boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def ingest_frontier(candidates: DataFrame, queue_path: str, checkpoint: str) -> StreamingQuery:
    """The first sight of every (job, url) of all time, one folder of the queue per batch."""
    schema = candidates.schema

    def unpacked(rows: DataFrame) -> DataFrame:
        whole = rows.select("normalized_url", F.from_json("row", schema, _EXACT).alias("row"))
        return whole.select("normalized_url", "row.*")

    return _started(first_sights(candidates), _write_batches(queue_path, unpacked), checkpoint)


def live_job_statistics(
    events: DataFrame, out_path: str, checkpoint: str, every: int = 16
) -> StreamingQuery:
    """Job counters kept up to date: each batch writes the counters that changed.

    After every so many batches the current counters of all jobs are written as a snapshot, so that a reader
    never opens more than one snapshot and ``every`` folders of changes, however long the stream has run.
    """
    updates = _write_batches(f"{out_path}/{UPDATES}", lambda rows: rows)

    def write(rows: DataFrame, batch_id: int) -> None:
        updates(rows, batch_id)
        if batch_id % every == every - 1:
            now = current_statistics(rows.sparkSession, out_path, batch_id, batch_id - 1)
            now.write.mode("overwrite").parquet(f"{out_path}/{SNAPSHOTS}/{UPTO}={batch_id}")

    return _started(job_statistics(events), write, checkpoint, "update")


UPDATES, SNAPSHOTS, UPTO = "updates", "snapshots", "upto"


def _numbered(files: Folder, below: str, key: str) -> list[int]:
    """Numbers of the complete folders ``key=<number>``."""
    names = [n for n in files.names(below) if n.startswith(f"{key}=")]
    return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in files.names(f"{below}/{n}"))


def statistics_folders(spark: SparkSession, out_path: str, last: int | None = None, upto: int | None = None) -> list[str]:
    """The folders that hold the current counters, newest last: a snapshot and the changes after it.

    ``last`` leaves later batches out, ``upto`` later snapshots.
    """
    files = Folder(spark, out_path)
    snapshots = [n for n in _numbered(files, SNAPSHOTS, UPTO) if upto is None or n <= upto]
    since = snapshots[-1] if snapshots else -1
    batches = [n for n in _numbered(files, UPDATES, BATCH) if n > since and (last is None or n <= last)]
    whole = [f"{out_path}/{SNAPSHOTS}/{UPTO}={since}"] if snapshots else []
    return whole + [f"{out_path}/{UPDATES}/{BATCH}={n}" for n in batches]


def current_statistics(spark: SparkSession, out_path: str, last: int | None = None, upto: int | None = None) -> DataFrame:
    """The latest counters per job of the update stream."""
    found = None
    for nth, folder in enumerate(statistics_folders(spark, out_path, last, upto)):
        rows = spark.read.parquet(folder).withColumn(BATCH, F.lit(nth))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise FileNotFoundError(f"no counters in {out_path}")
    row = F.struct(*[c for c in found.columns if c not in ("job_id", BATCH)])
    return found.groupBy("job_id").agg(F.max_by(row, BATCH).alias("s")).select("job_id", "s.*")
