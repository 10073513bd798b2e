"""Uniqueness and schema rules of the stored collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas
from pageloom.functions import urls

# The unique keys of the collections.
UNIQUE_KEYS = {
    "pages": ("url",),
    "url_queue": ("normalized_url", "job_id"),
    "site_structure": ("domain",),
}

# Fields a stored page must have.
REQUIRED_PAGE_FIELDS = (
    "_id", "url", "title",
    "content.clean_text", "content.content_hash", "content.word_count", "content.reading_time",
    "content.structured_data.headings", "content.structured_data.paragraphs",
    "content.structured_data.code_blocks", "content.structured_data.images",
    "content.structured_data.links", "content.structured_data.tables",
    "content.structured_data.lists",
    "metadata.scraped_at", "metadata.last_updated", "metadata.scraping_job_id",
    "metadata.response_time", "metadata.status_code", "metadata.content_length",
    "navigation.breadcrumb",
    "search_fields.searchable_text", "search_fields.keywords",
    "search_fields.tags", "search_fields.categories",
    "status", "version", "quality_score",
    "accessibility.has_alt_text", "accessibility.has_headings",
    "accessibility.readability_score",
)
REQUIRED_JOB_FIELDS = ("_id", "job_name", "job_type", "status", "start_time", "configuration")


def key_violations(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def has_field(schema: T.StructType, path: str) -> bool:
    for name in path.split("."):
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def _violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the broken rules; a rule that is null counts as broken."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return F.array_compact(F.array(*marks))


def validate_pages(pages: DataFrame) -> DataFrame:
    """Add ``violations``; a page is good when the array is empty."""

    def column(path: str) -> Column:
        return F.col(path) if has_field(pages.schema, path) else F.lit(None)

    rules = [(f"{path}: required", column(path).isNotNull()) for path in REQUIRED_PAGE_FIELDS]
    rules.append(("url: not an http url", urls.is_http_url(F.col("url"))))
    kind = F.coalesce(column("navigation.page_type"), F.lit("article"))
    rules.append(("navigation.page_type: unknown", kind.isin(*schemas.PAGE_TYPES)))
    if has_field(pages.schema, "content.structured_data.links"):
        rules.append(
            (
                "links.type: unknown",
                F.forall(
                    "content.structured_data.links", lambda x: x["type"].isin(*schemas.LINK_TYPES)
                ),
            )
        )
    if has_field(pages.schema, "content.structured_data.images"):
        rules.append(
            (
                "images.src: not an http url",
                F.forall("content.structured_data.images", lambda x: urls.is_http_url(x["src"])),
            )
        )
    return pages.withColumn("violations", _violations(rules))


def validate_jobs(jobs: DataFrame) -> DataFrame:
    rules = [(f"{path}: required", F.col(path).isNotNull()) for path in REQUIRED_JOB_FIELDS]
    rules.append(("status: unknown", F.col("status").isin(*schemas.JOB_STATUSES)))
    return jobs.withColumn("violations", _violations(rules))


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def one_per_key(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Enforce a unique key on write: the first row by ``order`` stays.

    An aggregate, not a window, so copies of one key are combined before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in table.columns])
    ranked = F.struct(*[F.col(c) for c in order])
    picked = table.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.min_by(row, ranked).alias("row")
    )
    return reduce(lambda d, k: d.drop(f"__{k}"), keys, picked).select("row.*")
