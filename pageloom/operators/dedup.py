"""Content dedup, change detection and versioned upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH = "content.content_hash"


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """Hashes held by more than one page, and which page is kept."""
    return (
        pages.groupBy(F.col(HASH).alias("content_hash"))
        .agg(
            F.count("*").alias("copies"),
            F.min(F.struct("metadata.scraped_at", "url"))["url"].alias("kept_url"),
        )
        .where(F.col("copies") > 1)
    )


def dedup_content(pages: DataFrame) -> DataFrame:
    """The first page seen of every content hash (``url`` must be unique).

    The winner is chosen on narrow rows with map-side combine, so a hash with very
    many copies is no hot task; page rows then move once, on the unique url.
    """
    first = F.min(F.struct("metadata.scraped_at", "url"))["url"]
    kept = pages.groupBy(HASH).agg(first.alias("url")).select("url")
    return pages.join(kept, "url", "left_semi")


def latest_per_url(batch: DataFrame) -> DataFrame:
    """One row per url of a batch: the newest, content hash as tie-break.

    An aggregate combines copies of a url before the shuffle, and its result is
    partitioned by url, as the joins that follow need it.
    """
    values = F.struct(*[c for c in batch.columns if c != "url"])
    newest = F.max_by(values, F.struct("metadata.scraped_at", HASH))
    return batch.groupBy("url").agg(newest.alias("row")).select("url", "row.*")


def changed_pages(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Pages of a batch whose (url, content) is not stored yet."""
    stored = current.select(F.col("url").alias("stored_url"), F.col(HASH).alias("stored_hash"))
    same = (F.col("url") == F.col("stored_url")) & (F.col(HASH) == F.col("stored_hash"))
    return batch.join(stored, same, "left_anti")


def upsert_pages(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The next state of ``pages``: new pages added, changed ones replaced.

    A changed page takes the next version and a new ``last_updated`` and keeps its
    first ``scraped_at``; an unchanged page is left as it is. Both sides have one
    row per url, so the join has no hot key.
    """
    old, new = current.alias("old"), latest_per_url(batch).alias("new")
    joined = old.join(new, F.col("old.url") == F.col("new.url"), "full_outer")
    is_old = F.col("old.url").isNotNull()
    keep_old = is_old & (
        F.col("new.url").isNull()
        | F.col("old.content.content_hash").eqNullSafe(F.col("new.content.content_hash"))
    )
    replaced = {
        "version": F.when(is_old, F.col("old.version") + 1).otherwise(F.col("new.version")),
        "metadata": F.when(
            is_old,
            F.col("new.metadata").withField("scraped_at", F.col("old.metadata.scraped_at")),
        ).otherwise(F.col("new.metadata")),
    }
    return joined.select(
        *[
            F.when(keep_old, F.col(f"old.{name}"))
            .otherwise(replaced.get(name, F.col(f"new.{name}")))
            .alias(name)
            for name in current.columns
        ]
    )
