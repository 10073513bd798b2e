"""Retention of queue rows and job errors."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.times import instant
from pageloom.sources.store import Transaction

DEFAULT_DAYS = 30
# Statuses of queue rows that may expire.
FINISHED = ("completed", "failed")


def cutoff(now: datetime, days: int = DEFAULT_DAYS) -> datetime:
    return now - timedelta(days=days)


def is_expired(limit: datetime) -> Column:
    """Finished queue rows found before the cutoff; null fields never expire."""
    old = F.col("discovered_at") < instant(limit)
    return F.coalesce(old & F.col("status").isin(*FINISHED), F.lit(False))


def retain_queue(queue: DataFrame, limit: datetime) -> DataFrame:
    return queue.where(~is_expired(limit))


def retain_errors(errors: DataFrame, limit: datetime) -> DataFrame:
    """Error rows that are kept."""
    old = F.col("timestamp") < instant(limit)
    return errors.where(~F.coalesce(old, F.lit(False)))


def prune_job_errors(jobs: DataFrame, limit: datetime) -> DataFrame:
    """The same inside the ``errors`` array of job documents."""
    at = instant(limit)
    return jobs.withColumn(
        "errors", F.filter("errors", lambda e: ~F.coalesce(e["timestamp"] < at, F.lit(False)))
    )


def retention_report(queue: DataFrame, limit: datetime) -> DataFrame:
    return queue.agg(
        F.count_if(is_expired(limit)).alias("deleted_queue_entries"),
        F.lit(limit.isoformat()).alias("cutoff_date"),
    )


# Rows by day: what has expired is left out of the next version of the store, and no row of a kept day is read.
CLOSED, DAY = "__closed", "__day"
QUEUE_DAYS, ERROR_DAYS = "url_queue_days", "job_error_days"


def keep_by_day(tx: Transaction, name: str, rows: DataFrame, at: str, closed: Column) -> None:
    """Add rows to a table whose parts hold one day of rows that may expire, or of rows that stay."""
    tx.append_parts(name, rows.withColumns({CLOSED: closed, DAY: F.to_date(at).cast("string")}), [CLOSED, DAY])


def keep_queue_by_day(tx: Transaction, queue: DataFrame) -> None:
    keep_by_day(tx, QUEUE_DAYS, queue, "discovered_at", F.coalesce(F.col("status").isin(*FINISHED), F.lit(False)))


def keep_errors_by_day(tx: Transaction, errors: DataFrame) -> None:
    keep_by_day(tx, ERROR_DAYS, errors, "timestamp", F.lit(True))


def drop_expired(tx: Transaction, name: str, at: str, limit: datetime) -> int:
    """Leave rows that may expire and are older than ``limit`` out of the next version; gives their number.

    Whole days go by name; their rows are counted from the files' footers. Only the day of the limit itself is
    read and written again, unless the limit is its first moment.
    """
    day = f"{limit:%Y-%m-%d}"
    parts = [p for p in tx.tables[name]["files"] if f"{CLOSED}=true/" in p]
    days = {p: p.rsplit(f"{DAY}=", 1)[1] for p in parts}
    gone = [p for p, d in days.items() if d < day and d[:1].isdigit()]
    torn = [p for p, d in days.items() if d == day] if limit.time() != time.min else []
    dropped = tx.folders(name, gone).count() if gone else 0
    if torn:
        rows = tx.folders(name, torn)
        rows = rows.drop(rows.columns[-1])
        late = F.col(at) >= instant(limit)
        dropped += rows.where(~late).count()
        tx.append_parts(name, rows.where(late), [CLOSED, DAY])
    tx.forget(name, [*gone, *torn])
    return dropped


def kept_rows(rows: DataFrame) -> DataFrame:
    """Rows of a table by day, without the columns that name its parts."""
    return rows.drop(CLOSED, DAY)
