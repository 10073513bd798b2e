"""Crawl jobs: opening, counters, progress, completion and error rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas
from pageloom.functions.times import instant

BYTES_PER_MB = 1024 * 1024


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a crawl beyond its start urls and allowed domains."""

    # The defaults that stored job documents carry.
    max_depth: int = 10
    delay_between_requests: float = 1.0
    concurrent_requests: int = 16
    user_agent: str = "pageloom/1.0"
    respect_robots_txt: bool = True
    download_images: bool = False
    timeout: int = 30
    retry_attempts: int = 3


def open_jobs(starts: DataFrame, config: CrawlConfig, now: datetime, site: str) -> DataFrame:
    """New rows of ``scraping_jobs`` for ``starts(job_id, start_urls, allowed_domains)``."""
    settings = asdict(config)

    def zeros(struct: T.StructType) -> Column:
        return F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in struct.fields])

    def empty(name: str) -> Column:
        return F.array().cast(schemas.SCRAPING_JOBS[name].dataType).alias(name)

    started = instant(now)
    return starts.select(
        F.col("job_id").alias("_id"),
        F.concat(
            F.lit(f"{site}_scrape_"), F.date_format(started, "yyyyMMdd_HHmmss")
        ).alias("job_name"),
        F.lit("full_crawl").alias("job_type"),
        started.alias("start_time"),
        F.lit(None).cast("timestamp").alias("end_time"),
        F.lit("running").alias("status"),
        F.struct(
            *[
                (F.lit(settings[f.name]).cast(f.dataType) if f.name in settings else F.col(f.name))
                .alias(f.name)
                for f in schemas.JOB_CONFIGURATION.fields
            ]
        ).alias("configuration"),
        zeros(schemas.JOB_STATISTICS).alias("statistics"),
        zeros(schemas.JOB_PROGRESS).alias("progress"),
        empty("errors"),
        empty("notifications"),
    )


def job_statistics(events: DataFrame) -> DataFrame:
    """The six counters of every job, from ``crawl_events``."""

    def n(kind: str):
        return F.count_if(F.col("kind") == kind)

    return events.groupBy("job_id").agg(
        n("discovered").alias("total_urls_discovered"),
        n("processed").alias("total_urls_processed"),
        n("scraped").alias("successfully_scraped"),
        n("failed").alias("failed_urls"),
        n("duplicate").alias("duplicate_urls"),
        (F.sum(F.when(F.col("kind") == "scraped", F.col("bytes")).otherwise(0)) / BYTES_PER_MB)
        .alias("total_size_mb"),
    )


def job_progress(queue: DataFrame) -> DataFrame:
    """Progress of every job from its queue rows (one per url, current status).

    A job is completed at its last update once nothing is pending or in process.
    """
    status = F.col("status")
    counts = queue.groupBy("job_id").agg(
        F.max("depth").alias("current_depth"),
        F.count_if(status == "pending").alias("urls_in_queue"),
        F.count_if(status == "processing").alias("urls_being_processed"),
        F.count_if(status.isin("completed", "skipped", "failed")).alias("done"),
        F.count("*").alias("discovered"),
        F.max("updated_at").alias("last_update"),
    )
    finished = (F.col("urls_in_queue") == 0) & (F.col("urls_being_processed") == 0)
    return counts.select(
        "job_id",
        "current_depth",
        "urls_in_queue",
        "urls_being_processed",
        (F.lit(100.0) * F.col("done") / F.col("discovered")).alias("percentage_complete"),
        F.when(finished, "completed").otherwise("running").alias("status"),
        F.when(finished, F.col("last_update")).alias("end_time"),
    )


def complete_jobs(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Running jobs that progress shows as finished get status and end time."""
    state = progress.select(
        F.col("job_id").alias("_id"),
        F.col("status").alias("new_status"),
        F.col("end_time").alias("new_end"),
    )
    closes = (F.col("status") == "running") & (F.col("new_status") == "completed")
    return (
        jobs.join(state, "_id", "left")
        .withColumn("end_time", F.when(closes, F.col("new_end")).otherwise(F.col("end_time")))
        .withColumn("status", F.when(closes, "completed").otherwise(F.col("status")))
        .drop("new_status", "new_end")
        .select(*jobs.columns)
    )


def error_log(failures: DataFrame) -> DataFrame:
    """Failed fetches (job_id, url, error_message, ts, attempt) as error rows.

    Errors stay rows keyed by job: a job may have any number of them.
    """
    return failures.select(
        "job_id",
        "url",
        F.lit("processing_error").alias("error_type"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.lit(0).alias("status_code"),
        F.col("ts").alias("timestamp"),
        (F.coalesce("attempt", F.lit(0)) + 1).alias("retry_count"),
    )
