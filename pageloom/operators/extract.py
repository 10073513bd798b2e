"""Fetched responses to page documents: map-only from the scan to the row written."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import dom, text, urls
from pageloom.operators.parse import MAX_ELEMENT_CHARS, PARSED, parse_pages

OUTCOMES = ("page", "skipped", "error")


def route_responses(raw: DataFrame) -> DataFrame:
    """Add ``outcome``: an error status, a skipped content type, or a page."""
    is_html = F.lower(F.coalesce("content_type", F.lit(""))).contains("text/html")
    return raw.withColumn(
        "outcome",
        F.when(F.col("status_code") >= 400, "error").when(~is_html, "skipped").otherwise("page"),
    )


def fetched_pages(raw: DataFrame) -> DataFrame:
    """The responses that become pages; the filter runs before any parsing."""
    return route_responses(raw).where(F.col("outcome") == "page").drop("outcome")


def parsed_ok(raw: DataFrame, keep_html: bool = False, found: Collection[str] = PARSED.names) -> DataFrame:
    return parse_pages(raw, keep_html, {*found, "parse_error"}).where(F.col("parse_error").isNull())


def whole_documents(parsed: DataFrame) -> DataFrame:
    """Pages whose element texts fit a document; the others are in ``parse_failures``."""
    return parsed.where(F.col("element_chars") <= MAX_ELEMENT_CHARS)


def parse_failures(raw: DataFrame) -> DataFrame:
    """Pages the tokenizer rejected or whose elements repeat too much, in the shape the error log takes."""
    repeats = F.concat(F.lit("ValueError: element texts add up to "), "element_chars", F.lit(" characters"))
    message = F.coalesce("parse_error", F.when(F.col("element_chars") > MAX_ELEMENT_CHARS, repeats))
    return (
        parse_pages(
            fetched_pages(raw).select("url", "html", "job_id", "fetched_at"), False, ("parse_error", "element_chars")
        )
        .withColumn("error_message", message)
        .where(F.col("error_message").isNotNull())
        .select("job_id", "url", "error_message", "fetched_at")
    )


def page_parts(raw: DataFrame, *keep: str, **parts: Column) -> DataFrame:
    """Parse only ``url`` and ``html`` (plus ``keep``) and select some parts."""
    columns = dict.fromkeys(["url", "html", *keep])
    return parsed_ok(raw.select(*columns), found=["nodes"]).select(
        *dict.fromkeys(["url", *keep]), *[expr.alias(name) for name, expr in parts.items()]
    )


def headings(raw: DataFrame, *keep: str) -> DataFrame:
    return _rows(page_parts(raw, *keep, item=dom.headings()), keep)


def paragraphs(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per paragraph, whatever paragraphs hold one another: memory is bounded by a page and one run."""
    ids = dict.fromkeys(["url", *keep])
    pages = parsed_ok(raw.select(*dict.fromkeys(["url", "html", *keep])), found=["nodes"])
    runs = pages.select(*ids, "nodes", F.explode(dom.paragraph_runs()).alias("r"))
    run = F.posexplode(dom.paragraph_run("r.first", "r.run")).alias("nth", "text")
    texts = runs.select(*ids, F.col("r.first").alias("first"), run)
    return texts.select(*ids, (F.col("first") + F.col("nth")).alias("pos"), "text")


def code_blocks(raw: DataFrame, *keep: str) -> DataFrame:
    return _rows(page_parts(raw, *keep, item=dom.code_blocks()), keep)


def images(raw: DataFrame, *keep: str) -> DataFrame:
    return _rows(page_parts(raw, *keep, item=dom.images()), keep)


def links(raw: DataFrame, *keep: str) -> DataFrame:
    return _rows(page_parts(raw, *keep, item=dom.links()), keep)


def lists(raw: DataFrame, *keep: str) -> DataFrame:
    return _rows(page_parts(raw, *keep, item=dom.lists()), keep)


def tables(raw: DataFrame, *keep: str) -> DataFrame:
    return _rows(page_parts(raw, *keep, item=dom.tables()), keep)


def table_cells(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per table cell: (table, row, column) positions and text."""
    return (
        tables(raw, *keep)
        .withColumnRenamed("pos", "table_pos")
        .select("*", F.posexplode("rows").alias("row_pos", "cells"))
        .select("*", F.posexplode("cells").alias("col_pos", "text"))
        .drop("rows", "cells")
    )


def _rows(parts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    ids = dict.fromkeys(["url", *keep])
    return parts.select(*ids, F.posexplode("item").alias("pos", "item")).select(
        *ids, "pos", "item.*"
    )


def discovered_hrefs(raw: DataFrame, *keep: str) -> DataFrame:
    """Every ``a[href]`` of the page as fetched, boilerplate included."""
    return hrefs(parsed_ok(raw.select(*dict.fromkeys(["url", "html", *keep])), found=["hrefs"]), *keep)


def hrefs(parsed: DataFrame, *keep: str) -> DataFrame:
    ids = dict.fromkeys(["url", *keep])
    return parsed.select(*ids, F.posexplode("hrefs").alias("pos", "item")).select(
        *ids, "pos", "item.raw", F.coalesce("item.url", "item.raw").alias("href")
    )


def navigation(url: Column) -> Column:
    return F.struct(
        dom.breadcrumb().alias("breadcrumb"),
        dom.step_link(dom.NEXT_WORDS).alias("next_page"),
        dom.step_link(dom.PREVIOUS_WORDS).alias("prev_page"),
        urls.section(url).alias("section"),
        urls.subsection(url).alias("subsection"),
        urls.page_type(url).alias("page_type"),
        F.lit(0).alias("menu_position"),
    )


def part_columns() -> dict[str, Column]:
    """The page parts, one column each.

    They stay separate columns until the document is put together: a column used
    in several places is evaluated once, a struct read field by field is not.
    """
    return {
        "headings": dom.headings(),
        "paragraphs": dom.paragraphs(),
        "code_blocks": dom.code_blocks(),
        "images": dom.images(),
        "links": dom.links(),
        "tables": dom.tables(),
        "lists": dom.lists(),
        "has_main": dom.has_element("main"),
        "has_title": dom.has_element("title"),
        "has_description": dom.has_description(),
        "all_alt": dom.all_images_have_alt(),
        "readability": text.readability(dom.raw_text()),
    }


def quality_score() -> Column:
    """Points for what a page has, from the part columns.

    The navigation bonus cannot be reached, because navigation is dropped as
    boilerplate, so 95 is the top.
    """

    def points(condition: Column | str, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    def some(name: str) -> Column:
        return F.size(name) > 0

    with_alt = F.size(F.filter("images", lambda i: i["alt"] != ""))
    body = text.bind(
        text.word_count(F.array_join("paragraphs", " ")),
        lambda words: F.when(words >= 300, 15).when(words >= 100, 10).otherwise(0),
    )
    total = (
        points(some("headings"), 20)
        + points(F.size("paragraphs") >= 3, 15)
        + points(some("images"), 10)
        + F.least(F.lit(10), with_alt * 2)
        + points(some("links"), 10)
        + body
        + points(F.col("has_main"), 5)
        + points(F.col("has_description"), 5)
        + points(F.col("has_title"), 5)
    )
    return F.least(F.lit(100), total).cast("double")


def accessibility() -> Column:
    return F.struct(
        F.col("all_alt").alias("has_alt_text"),
        (F.size("headings") > 0).alias("has_headings"),
        F.lit("unknown").alias("color_contrast"),
        F.col("readability").alias("readability_score"),
    )


def assemble(parsed: DataFrame) -> DataFrame:
    """Parsed responses to page documents (``schemas.PAGES``)."""
    url = F.col("url")
    parts = parsed.select(
        "*",
        dom.title().alias("title"),
        dom.clean_text().alias("clean_text"),
        *[column.alias(name) for name, column in part_columns().items()],
    )
    words = text.word_count(F.col("clean_text"))
    headers = F.col("headers")
    return parts.select(
        urls.page_id(url).alias("_id"),
        "url",
        "title",
        F.struct(
            F.col("html").alias("raw_html"),
            "clean_text",
            F.struct(*schemas.STRUCTURED_DATA.names).alias("structured_data"),
            text.content_hash(F.col("clean_text")).alias("content_hash"),
            words.alias("word_count"),
            text.reading_time(words).alias("reading_time"),
        ).alias("content"),
        F.struct(
            F.col("fetched_at").alias("scraped_at"),
            F.col("fetched_at").alias("last_updated"),
            headers["last-modified"].alias("last_modified"),
            parse_http_date(headers["last-modified"]).alias("last_modified_at"),
            headers["etag"].alias("etag"),
            F.col("job_id").alias("scraping_job_id"),
            F.col("depth").alias("page_depth"),
            "parent_url",
            "response_time",
            F.lit(200).alias("status_code"),
            F.octet_length("html").cast("long").alias("content_length"),
            F.lit("en").alias("language"),
            "html_lang",
            F.lit("utf-8").alias("charset"),
        ).alias("metadata"),
        navigation(url).alias("navigation"),
        dom.seo().alias("seo"),
        F.struct(
            text.searchable_text(F.col("title"), F.col("clean_text")).alias("searchable_text"),
            text.keywords(F.col("clean_text")).alias("keywords"),
            F.array().cast("array<string>").alias("tags"),
            F.array().cast("array<string>").alias("categories"),
        ).alias("search_fields"),
        F.lit("processed").alias("status"),
        F.lit(1).alias("version"),
        quality_score().alias("quality_score"),
        accessibility().alias("accessibility"),
    )


def parse_http_date(value: Column) -> Column:
    """``Tue, 02 Jan 2024 03:04:05 GMT`` as a timestamp, null when malformed."""
    day = F.regexp_extract(value, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))


def extract_pages(raw: DataFrame) -> DataFrame:
    """Route, parse and assemble: no shuffle anywhere."""
    return assemble(whole_documents(parsed_ok(fetched_pages(raw), keep_html=True)))
