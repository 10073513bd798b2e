"""Listing, lookup, roll-up and statistics queries over the stored collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGES, MAX_PAGES = 20, 100
DEFAULT_JOBS, MAX_JOBS = 10, 50


def paged(rows: DataFrame, order: list[Column], limit: int, skip: int, most: int) -> DataFrame:
    """Sorted slice; planned as a top-k, so only limit + skip rows per task survive."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if skip < 0:
        raise ValueError("skip must not be negative")
    return rows.orderBy(*order).offset(skip).limit(limit)


def comes_after(order: Sequence[tuple[str, bool]], values: Sequence[object]) -> Column:
    """Whether a row sorts behind a given one; ``order`` is (column, descending), as ``asc`` and ``desc`` place nulls.

    The condition on the first column stands alone as well, so that it reaches the files and skips row groups.
    """

    def behind(name: str, descending: bool, value: object) -> Column:
        column = F.col(name)
        if descending:  # nulls last
            return F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
        return column.isNotNull() if value is None else column > F.lit(value)

    rest = F.lit(False)
    for (name, descending), value in reversed(list(zip(order, values, strict=True))):
        rest = behind(name, descending, value) | (F.col(name).eqNullSafe(F.lit(value)) & rest)
    (name, descending), value = order[0], values[0]
    bound = F.col(name) <= F.lit(value) if descending else F.col(name) >= F.lit(value)
    if value is None:
        return rest
    return rest & ((bound | F.col(name).isNull()) if descending else bound)


def seek(
    rows: DataFrame, order: Sequence[tuple[str, bool]], limit: int, most: int, after: Sequence[object] | None
) -> DataFrame:
    """The next ``limit`` rows behind a cursor: every page of results costs what the first one costs."""
    if after is not None:
        rows = rows.where(comes_after(order, after))
    return paged(rows, [F.desc(c) if descending else F.asc(c) for c, descending in order], limit, 0, most)


def cursor(page: DataFrame, order: Sequence[tuple[str, bool]]) -> tuple | None:
    """Where a page of results (at most as many rows as a page may have) ends; None if it is empty."""
    last = page.orderBy(*[F.desc(c) if descending else F.asc(c) for c, descending in order]).tail(1)
    return tuple(last[0][c] for c, _ in order) if last else None


LISTING = (("quality_score", True), ("last_updated", True), ("url", False))


def filter_pages(
    pages: DataFrame,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
) -> DataFrame:
    """Optional equality and minimum filters; an empty value or 0 means no filter."""
    if section:
        pages = pages.where(F.col("navigation.section") == section)
    if subsection:
        pages = pages.where(F.col("navigation.subsection") == subsection)
    if min_quality:
        pages = pages.where(F.col("quality_score") >= min_quality)
    return pages


def page_summary(pages: DataFrame, *extra: str) -> DataFrame:
    return pages.select(
        "_id",
        "url",
        "title",
        F.col("navigation.section").alias("section"),
        F.col("navigation.subsection").alias("subsection"),
        F.col("content.word_count").alias("word_count"),
        F.col("content.reading_time").alias("reading_time"),
        "quality_score",
        F.col("metadata.scraped_at").alias("scraped_at"),
        *extra,
    )


def page_detail(pages: DataFrame) -> DataFrame:
    return pages.select(
        "_id",
        "url",
        "title",
        "content",
        "metadata",
        "navigation",
        "seo",
        "search_fields",
        "status",
        "version",
        "quality_score",
        "accessibility",
    )


def list_pages(
    pages: DataFrame,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
    limit: int = DEFAULT_PAGES,
    skip: int = 0,
) -> DataFrame:
    """Best quality first, then last updated, then url."""
    rows = page_summary(
        filter_pages(pages, section, subsection, min_quality),
        "metadata.last_updated",
    )
    order = [F.desc("quality_score"), F.desc("last_updated"), F.asc("url")]
    return paged(rows, order, limit, skip, MAX_PAGES)


def list_pages_after(
    pages: DataFrame,
    after: Sequence[object] | None = None,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
    limit: int = DEFAULT_PAGES,
) -> DataFrame:
    """As ``list_pages``, but from a cursor: the ``LISTING`` values of the last row seen."""
    rows = page_summary(filter_pages(pages, section, subsection, min_quality), "metadata.last_updated")
    return seek(rows, LISTING, limit, MAX_PAGES, after)


def page_by_id(pages: DataFrame, page_id: str | Column) -> DataFrame:
    return pages.where(F.col("_id") == page_id)


JOB_SUMMARY = ("_id", "job_name", "status", "start_time", "end_time", "statistics")


def list_jobs(jobs: DataFrame, limit: int = DEFAULT_JOBS) -> DataFrame:
    rows = jobs.select(*JOB_SUMMARY)
    return paged(rows, [F.desc("start_time"), F.asc("_id")], limit, 0, MAX_JOBS)


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("_id") == job_id)


def job_errors(errors: DataFrame, job_id: str) -> DataFrame:
    """The error rows of a job, oldest first."""
    return errors.where(F.col("job_id") == job_id).orderBy("timestamp", "url")


def latest_job(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("start_time"), F.asc("_id")).limit(1)


def _section() -> Column:
    name = F.col("navigation.section")
    return F.when(F.coalesce(name, F.lit("")) == "", "root").otherwise(name).alias("section")


def _subsection() -> Column:
    return F.coalesce("navigation.subsection", F.lit("")).alias("subsection")


def _measures() -> list[Column]:
    return [F.count("*").alias("page_count"), F.avg("quality_score").alias("avg_quality")]


def site_structure(pages: DataFrame) -> DataFrame:
    """Pages and mean quality per (section, subsection)."""
    return pages.groupBy(_section(), _subsection()).agg(*_measures())


def structure_pages(pages: DataFrame) -> DataFrame:
    """The pages of every (section, subsection) group, as rows: a group may hold any
    share of the site, so it is never gathered into one array."""
    return pages.select(_section(), _subsection(), "title", "url", "quality_score")


def section_rollup(pages: DataFrame) -> DataFrame:
    """Roll-up of ``site_structure`` to sections, as rows of two levels.

    ``level`` is ``section`` (totals, mean weighted by pages, number of
    subsections) or ``subsection``. Pages without a subsection count in their
    section's total only.
    """
    groups = pages.groupBy(_section(), _subsection()).agg(
        F.count("*").alias("page_count"), F.sum("quality_score").alias("quality")
    )
    # Every group feeds its section, and its own line when it has a name. The second
    # aggregate runs on groups, so pages are read and shuffled once.
    named = F.col("subsection") != ""
    section_line = F.struct(F.lit("section").alias("level"), F.lit("").alias("name"))
    own_line = F.struct(F.lit("subsection").alias("level"), F.col("subsection").alias("name"))
    lines = F.when(named, F.array(section_line, own_line)).otherwise(F.array(section_line))
    return (
        groups.withColumn("named", named)
        .withColumn("line", F.explode(lines))
        .groupBy("line.level", "section", F.col("line.name").alias("subsection"))
        .agg(
            F.sum("page_count").alias("page_count"),
            (F.sum("quality") / F.sum("page_count")).alias("avg_quality"),
            F.count_if(F.col("named") & (F.col("line.level") == "section")).alias("subsections"),
        )
    )


def _totals() -> list[Column]:
    return [
        F.count("*").alias("total_pages"),
        F.coalesce(F.sum("content.word_count"), F.lit(0)).alias("total_words"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality_score"),
    ]


def content_statistics(pages: DataFrame) -> DataFrame:
    return pages.agg(*_totals())


def structure_report(pages: DataFrame) -> DataFrame:
    """Site totals and the groups below them, as rows of two levels.

    The totals are taken from the groups, so pages are read and shuffled once.
    """
    groups = pages.groupBy(_section(), _subsection()).agg(
        F.count("*").alias("page_count"),
        F.coalesce(F.sum("content.word_count"), F.lit(0)).alias("words"),
        F.sum("quality_score").alias("quality"),
    )
    site = groups.agg(
        F.lit("site").alias("level"),
        F.lit("").alias("section"),
        F.lit("").alias("subsection"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("page_count", "words", "quality")],
    )
    mean = F.coalesce(F.try_divide("quality", "page_count"), F.lit(0.0)).alias("avg_quality")
    return (
        site.unionByName(groups.withColumn("level", F.lit("group")))
        .select("level", "section", "subsection", "page_count", "words", mean)
    )


def statistics_report(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Content statistics with the latest job, one row; the job is null if there is none."""
    job = latest_job(jobs).select(
        F.struct(
            "job_name", "status", "start_time", "end_time", "statistics", "progress"
        ).alias("job")
    )
    return content_statistics(pages).withColumn("latest_job", job.scalar())
