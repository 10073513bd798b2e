"""The registered queries: every operator over whole given tables.

Results are flat: timestamps as text, arrays as rows, joined strings or hashes,
means rounded to six digits.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import dom, text, urls
from pageloom.operators import (
    closure,
    dedup,
    extract,
    frontier,
    jobs,
    links,
    maintenance,
    patterns as patterns_table,
    rollups,
    validate,
)
from pageloom.plans import catalog, inputs, prepared, search
from pageloom.session import cut_lineage, shared_dir
from pageloom.sources.store import Store
from pageloom.streaming import streams

NOW = datetime(2024, 2, 1)
AGENT = "loom/1.0"
SEARCH = "thing thtion license"
PHRASE_SEARCH = '"of the" thing -license'
INDEX_SEARCH = '"of the" updated -license'
EXCLUDED = ("/t[a-h]", "[?&]utm_", "ing$")
DOMAINS = ("blog.tionsh.example.com", "tionble.example.org", "blog.ththan.example.net")
JOB = "job-3"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def when_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column.split(".")[-1])


def rounded(column: str | Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


# Scans, sources, sinks


@register
def scan_raw_pages(spark, sf):
    return inputs.raw_pages(spark, sf).select(
        "url",
        F.octet_length("html").alias("bytes"),
        "status_code",
        "content_type",
        F.col("headers")["etag"].alias("etag"),
        "response_time",
        when_text("fetched_at"),
        "job_id",
        "depth",
    )


@register
def route_responses(spark, sf):
    return extract.route_responses(inputs.raw_pages(spark, sf)).select(
        "url", "status_code", "content_type", "outcome"
    )


@register
def upsert_pages(spark, sf):
    stored = inputs.page_docs(spark, sf).drop("search_fields")
    crawled = inputs.page_docs_next(spark, sf).drop("search_fields")
    return dedup.upsert_pages(stored, crawled).select(
        "url",
        "version",
        F.col("content.content_hash").alias("content_hash"),
        when_text("metadata.scraped_at"),
        when_text("metadata.last_updated"),
    )


def _versions(pages: DataFrame) -> DataFrame:
    return pages.select(
        "url",
        "version",
        F.col("content.content_hash").alias("content_hash"),
        when_text("metadata.scraped_at"),
        when_text("metadata.last_updated"),
    )


@register
def saved_pages(spark, sf):
    """The stored pages after the second crawl was saved."""
    return _versions(prepared.crawl_store(spark, sf).pages(prepared.NEXT))


@register
def saved_pages_before(spark, sf):
    """The stored pages as of the first crawl, read after later commits."""
    return _versions(prepared.crawl_store(spark, sf).pages(prepared.FIRST))


@register
def saved_pages_last(spark, sf):
    """The stored pages after some were removed."""
    return _versions(prepared.crawl_store(spark, sf).pages(prepared.LAST))


@register
def stored_collections(spark, sf):
    """Rows of every collection in every version of the store."""
    store = prepared.crawl_store(spark, sf).store
    names = ("pages", "scraping_jobs", "url_queue")
    counts = [
        store.table(name, version).agg(F.count("*").alias("rows")).select(
            F.lit(version).alias("version"), F.lit(name).alias("collection"), "rows"
        )
        for version in (prepared.FIRST, prepared.NEXT, prepared.LAST)
        for name in names
    ]
    return functools.reduce(DataFrame.unionAll, counts)


@register
def stored_page(spark, sf):
    """One page by its id: one bucket of the store is read."""
    pages = prepared.crawl_store(spark, sf)
    wanted = pages.pages(prepared.NEXT).agg(F.min("_id")).first()[0]
    return pages.store.lookup("pages", [wanted], prepared.NEXT).select(
        *("_id", "url", "title", "content.content_hash", "content.word_count", "content.reading_time"),
        when_text("metadata.scraped_at"),
        when_text("metadata.last_updated"),
        *("metadata.scraping_job_id", "navigation.section", "navigation.subsection", "navigation.page_type"),
        F.array_join("search_fields.keywords", "|").alias("keywords"),
        *("status", "version", "quality_score"),
    )


@register
def key_violations(spark, sf):
    return validate.key_violations(
        inputs.url_queue(spark, sf), validate.UNIQUE_KEYS["url_queue"]
    )


@register
def validate_pages(spark, sf):
    """All violations of whole page documents, some of them spoiled by language."""
    pages = extract.extract_pages(inputs.rich_responses(spark, sf))
    lang, kind = F.col("metadata.html_lang"), F.col("navigation.page_type")
    took = F.when(lang != "de", F.col("metadata.response_time"))
    pages = (
        pages.withColumn("quality_score", F.when(lang != "fr", F.col("quality_score")))
        .withColumn(
            "navigation",
            F.col("navigation").withField("page_type", F.when(lang == "es", "story").otherwise(kind)),
        )
        .withColumn("metadata", F.col("metadata").withField("response_time", took))
    )
    checked = validate.validate_pages(pages)
    return checked.select("url", F.array_join("violations", "; ").alias("violations"))


@register
def validate_jobs(spark, sf):
    """Violations of the jobs opened for the pages, some of them spoiled by number."""
    number = F.substring("_id", 5, 20).cast("long")
    opened = (
        _opened_jobs(spark, sf)
        .withColumn("status", F.when(number % 7 == 0, "stopped").otherwise(F.col("status")))
        .withColumn("job_name", F.when(number % 13 != 0, F.col("job_name")))
        .withColumn("configuration", F.when(number % 11 != 0, F.col("configuration")))
    )
    checked = validate.rejected_rows(validate.validate_jobs(opened))
    return checked.select("_id", F.array_join("violations", "; ").alias("violations"))


# URL functions


@register
def normalize_url(spark, sf):
    pages = inputs.pages_table(spark, sf).select("url")
    queue = inputs.url_queue(spark, sf).select("url").distinct()
    return pages.union(queue).select("url", urls.normalize_url(F.col("url")).alias("normalized"))


@register
def link_types(spark, sf):
    found = extract.discovered_hrefs(inputs.rich_pages(spark, sf))
    return found.select(
        "url", "href", urls.link_type(F.col("href"), F.col("url")).alias("type")
    )


@register
def url_sections(spark, sf):
    return inputs.pages_table(spark, sf).select(
        "url",
        urls.section(F.col("url")).alias("section"),
        urls.subsection(F.col("url")).alias("subsection"),
    )


@register
def url_page_type(spark, sf):
    """Page urls with the page type names of the documents' own words in the path."""
    kinds = F.element_at(
        F.array(*[F.lit(k) for k in ("blog", "docs", "documentation", "about", "contact", "x")]),
        (F.length("source") * 3 + F.length("lang") + F.col("doc_id") % 6).cast("int") % 6 + 1,
    )
    url = F.concat(F.lit("https://"), "source", F.lit("/"), "lang", F.lit("/"), kinds, F.lit("//p"))
    homes = F.concat(F.lit("https://"), "source", F.lit("?q="), "lang")
    docs = inputs.documents_table(spark, sf)
    both = docs.select("doc_id", url.alias("url")).union(docs.select("doc_id", homes))
    return both.select("doc_id", "url", urls.page_type(F.col("url")).alias("page_type"))


@register
def allowed_links(spark, sf):
    domains = inputs.documents_table(spark, sf).where(F.col("source").endswith("1")).select(
        F.concat("source", F.lit(".example.com")).alias("domain")
    )
    hrefs = extract.discovered_hrefs(inputs.rich_pages(spark, sf))
    return links.allowed_links_by_table(hrefs, domains).select("url", "href")


@register
def excluded_urls(spark, sf):
    return inputs.pages_table(spark, sf).select(
        "url", frontier.excluded(F.col("url"), EXCLUDED).alias("is_excluded")
    )


@register
def excluded_by_table(spark, sf):
    """Page urls against a table of patterns: one from the first word of every document."""
    word = F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1))
    patterns = inputs.documents_table(spark, sf).where(word != "").select(
        F.concat(F.lit("[/.]"), F.substring(word, 1, 6), F.lit("[a-z]*(?:[/.?]|$)")).alias("pattern")
    )
    rows = inputs.pages_table(spark, sf).select("url")
    return patterns_table.excluded_by_table(rows, patterns)


@register
def robots_filter(spark, sf):
    rules = inputs.robots_rules(spark, sf, inputs.section_prefix())
    rows = inputs.pages_table(spark, sf).select("url")
    return frontier.robots_allowed(rows, rules, AGENT).select("url", "robots_ok")


# Page extraction


@register
def extract_pages(spark, sf):
    return page_digest(extract.extract_pages(inputs.raw_pages(spark, sf)))


def page_digest(pages: DataFrame) -> DataFrame:
    return pages.select(
        "_id",
        "url",
        "title",
        F.col("content.content_hash").alias("content_hash"),
        F.col("content.word_count").alias("word_count"),
        F.col("content.reading_time").alias("reading_time"),
        F.size("content.structured_data.paragraphs").alias("paragraphs"),
        F.size("content.structured_data.links").alias("links"),
        F.col("metadata.html_lang").alias("html_lang"),
        "quality_score",
    )


@register
def extract_rich_pages(spark, sf):
    """Clean text of generated pages that hold every kind of element."""
    pages = extract.page_parts(inputs.rich_pages(spark, sf), "doc_id", clean=dom.clean_text())
    return pages.select(
        "doc_id",
        F.md5("clean").alias("content_hash"),
        text.word_count(F.col("clean")).alias("word_count"),
    )


@register
def page_titles(spark, sf):
    return extract.page_parts(inputs.pages_table(spark, sf), title=dom.title())


@register
def page_headings(spark, sf):
    return extract.headings(inputs.pages_table(spark, sf))


@register
def page_paragraphs(spark, sf):
    return extract.paragraphs(inputs.pages_table(spark, sf)).select(
        "url", "pos", F.md5("text").alias("text_hash"), F.length("text").alias("chars")
    )


@register
def page_code_blocks(spark, sf):
    return extract.code_blocks(inputs.rich_pages(spark, sf)).select(
        "url", "pos", "language", F.md5("content").alias("content_hash"), "file_name"
    )


@register
def page_images(spark, sf):
    return extract.images(inputs.rich_pages(spark, sf))


@register
def page_links(spark, sf):
    return extract.links(inputs.rich_pages(spark, sf))


@register
def page_tables(spark, sf):
    return extract.table_cells(inputs.rich_pages(spark, sf)).select(
        "url",
        "table_pos",
        F.array_join("headers", "|").alias("headers"),
        "caption",
        "row_pos",
        "col_pos",
        "text",
    )


@register
def page_lists(spark, sf):
    return extract.lists(inputs.rich_pages(spark, sf)).select(
        "url", "pos", "type", F.array_join("items", "|").alias("items")
    )


@register
def page_navigation(spark, sf):
    nav = extract.page_parts(
        inputs.rich_pages(spark, sf), nav=extract.navigation(F.col("url"))
    )
    return nav.select(
        "url",
        F.array_join("nav.breadcrumb", "|").alias("breadcrumb"),
        "nav.next_page",
        "nav.prev_page",
        "nav.section",
        "nav.subsection",
        "nav.page_type",
        "nav.menu_position",
    )


@register
def page_seo(spark, sf):
    seo = extract.page_parts(inputs.rich_pages(spark, sf), seo=dom.seo())
    return seo.select("url", "seo.*").withColumn(
        "meta_keywords", F.array_join("meta_keywords", "|")
    )


def _scored(pages: DataFrame) -> DataFrame:
    return extract.page_parts(pages, **extract.part_columns())


@register
def page_accessibility(spark, sf):
    return (
        _scored(inputs.rich_pages(spark, sf))
        .select("url", extract.accessibility().alias("a"))
        .select(
            "url",
            "a.has_alt_text",
            "a.has_headings",
            "a.color_contrast",
            rounded("a.readability_score", "readability_score"),
        )
    )


@register
def quality_score(spark, sf):
    return _scored(inputs.rich_pages(spark, sf)).select(
        "url", extract.quality_score().alias("quality_score")
    )


@register
def discover_links(spark, sf):
    return links.discover_links(extract.discovered_hrefs(inputs.pages_table(spark, sf)), DOMAINS)


# Derived columns


@register
def word_stats(spark, sf):
    body = F.col("text")
    words = text.word_count(body)
    return inputs.documents_table(spark, sf).select(
        "doc_id",
        words.alias("word_count"),
        text.reading_time(words).alias("reading_time"),
        F.md5(text.searchable_text(F.col("source"), body)).alias("searchable_hash"),
    )


@register
def content_hash(spark, sf):
    return inputs.documents_table(spark, sf).select(
        "doc_id", text.content_hash(F.col("text")).alias("content_hash")
    )


@register
def top_keywords(spark, sf):
    return inputs.documents_table(spark, sf).select(
        "doc_id", F.posexplode(text.keywords(F.col("text"))).alias("rank", "keyword")
    )


@register
def readability(spark, sf):
    return inputs.documents_table(spark, sf).select(
        "doc_id", rounded(text.readability(F.col("text")), "readability_score")
    )


@register
def page_metadata(spark, sf):
    pages = extract.extract_pages(inputs.raw_pages(spark, sf))
    return pages.select(
        "url",
        when_text("metadata.scraped_at"),
        "metadata.last_modified",
        # The header is in GMT whatever the time zone of the session.
        F.date_format(
            F.to_utc_timestamp("metadata.last_modified_at", F.current_timezone()),
            "yyyy-MM-dd HH:mm:ss",
        ).alias("last_modified_at"),
        "metadata.etag",
        "metadata.scraping_job_id",
        "metadata.page_depth",
        "metadata.response_time",
        "metadata.status_code",
        "metadata.content_length",
        "metadata.language",
        "metadata.charset",
        "status",
        "version",
    )


# Frontier and link graph


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages above the depth limit, in page and link order."""
    pages = inputs.lift_raw_pages(inputs.pages_table(spark, sf), "page_id")
    hrefs = extract.discovered_hrefs(pages, "job_id", "depth", "page_id")
    first_seen = hrefs.groupBy("job_id", "depth", "page_id", "url", "href").agg(
        F.min("pos").alias("pos")
    )
    # Three branches read the links, so pages are parsed once and the links written.
    return cut_lineage(
        first_seen.select(
            "job_id",
            F.col("href").alias("url"),
            F.col("url").alias("parent_url"),
            "depth",
            F.struct("page_id", "pos").alias("seq"),
        )
    )


def _queue_inputs(spark: SparkSession, sf: str) -> tuple:
    """Links one level down, what the queue holds (links of the deepest pages), rules."""
    rows = _candidates(spark, sf)
    known = rows.where(F.col("depth") == 3).select(
        "job_id", urls.normalize_url(F.col("url")).alias("normalized_url")
    )
    rules = inputs.robots_rules(spark, sf, inputs.first_link_prefix())
    return frontier.followed(rows, max_depth=3), known, rules, AGENT, EXCLUDED


@register
def enqueue_links(spark, sf):
    entering = frontier.enqueue(*_queue_inputs(spark, sf))
    return frontier.queue_rows(entering, NOW).select(
        "url",
        "normalized_url",
        "status",
        "priority",
        when_text("discovered_at"),
        "job_id",
        "depth",
        "parent_url",
        "discovery_method",
    )


@register
def enqueue_outcomes(spark, sf):
    outcomes = frontier.enqueue_outcomes(*_queue_inputs(spark, sf))
    return outcomes.groupBy("job_id", "outcome").agg(F.count("*").alias("urls"))


@register
def seed_urls(spark, sf):
    """Start urls: repeated ones count as duplicates."""
    starts = inputs.events_table(spark, sf).select(
        inputs._job_id().alias("job_id"),
        inputs._event_url().alias("url"),
        F.col("event_id").alias("seq"),
    )
    none = inputs.url_queue(spark, sf).where(F.lit(False))
    entering = frontier.enqueue(frontier.seed_candidates(starts), none)
    return frontier.queue_rows(entering, NOW, priority=1).select(
        "job_id", "url", "normalized_url", "priority", "depth"
    )


@register
def crawl_closure(spark, sf):
    """All that the seeds reach."""
    seeds = spark.range(2).withColumnRenamed("id", "node")
    return frontier.crawl_closure(cut_lineage(inputs.edges(spark, sf)), seeds, max_depth=None)


@register
def crawl_closure_continued(spark, sf):
    """The same walk from a stored closure: first over a part of the links, then on when the rest arrive."""
    seeds = spark.range(2).withColumnRenamed("id", "node")
    edges = cut_lineage(inputs.edges(spark, sf))
    late = F.col("src") % 10 == 3
    stored = closure.StoredClosure(spark)
    stored.add(edges.where(~late), seeds)
    stored.add(edges.where(late))
    return stored.reached()


@register
def crawl_closure_limited(spark, sf):
    """What the seeds reach within the crawler's depth limit."""
    seeds = spark.range(2).withColumnRenamed("id", "node")
    return frontier.crawl_closure(cut_lineage(inputs.edges(spark, sf)), seeds)


@register
def pending_batch(spark, sf):
    return frontier.pending_batch(inputs.url_queue(spark, sf), NOW, limit=16).select(
        "job_id", "rank", "priority", when_text("discovered_at"), "normalized_url"
    )


@register
def url_status_latest(spark, sf):
    return frontier.status_latest(_transitions(spark, sf)).select(
        "job_id", "url", "status", when_text("updated_at")
    )


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.url_queue(spark, sf).select(
        "job_id", "url", "status", F.col("discovered_at").alias("ts"), "seq", "depth"
    )


@register
def retry_schedule(spark, sf):
    failed = inputs.url_queue(spark, sf).where(F.col("status") == "failed")
    return frontier.retry_schedule(failed, NOW).select(
        "seq", "url", "attempts", "status", when_text("next_retry")
    )


@register
def error_log(spark, sf):
    failed = inputs.crawl_events(spark, sf).where(F.col("kind") == "failed")
    return jobs.error_log(failed).select(
        "job_id",
        "url",
        "error_type",
        "error_message",
        "status_code",
        when_text("timestamp"),
        "retry_count",
    )


@register
def validate_links(spark, sf):
    found = cut_lineage(extract.links(inputs.rich_pages(spark, sf)))
    return links.validate_links(found, inputs.link_checks(found)).select(
        "url", "pos", "href", "status"
    )


@register
def validated_page_links(spark, sf):
    """The link array of every page with the answers of the checks in it."""
    found = cut_lineage(extract.links(inputs.rich_pages(spark, sf)))
    pages = links.collect_links(links.validate_links(found, inputs.link_checks(found)))
    fields = ("href", "text", "title", "type", "status")
    line = F.transform("links", lambda i: F.concat_ws("|", *[i[f] for f in fields]))
    return pages.select("url", F.array_join(line, "\n").alias("links"))


def _opened_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A job for every crawled page's site, started at the page."""
    url = F.col("url")
    starts = inputs.pages_table(spark, sf).select(
        F.concat(F.lit("job-"), F.col("page_id").cast("string")).alias("job_id"),
        F.array(url).alias("start_urls"),
        F.array(urls.netloc(url)).alias("allowed_domains"),
    )
    return jobs.open_jobs(starts, jobs.CrawlConfig(), NOW, "site")


@register
def open_job(spark, sf):
    return _opened_jobs(spark, sf).select(
        "_id",
        "job_name",
        "job_type",
        when_text("start_time"),
        "status",
        F.array_join("configuration.start_urls", "|").alias("start_urls"),
        F.array_join("configuration.allowed_domains", "|").alias("allowed_domains"),
        "configuration.max_depth",
        "configuration.retry_attempts",
        "statistics.total_urls_discovered",
        "progress.percentage_complete",
        F.size("errors").alias("errors"),
    )


# Dedup and incremental update


@register
def dedup_content(spark, sf):
    return dedup.dedup_content(inputs.page_docs(spark, sf)).select(
        "url", F.col("content.content_hash").alias("content_hash")
    )


@register
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(inputs.page_docs(spark, sf))


@register
def changed_pages(spark, sf):
    return dedup.changed_pages(
        inputs.page_docs_next(spark, sf), inputs.page_docs(spark, sf)
    ).select("url", F.col("content.content_hash").alias("content_hash"))


# Queries


SUMMARY = ("_id", "url", "title", "section", "subsection", "word_count", "reading_time")


def _summary(rows: DataFrame, *extra: str | Column) -> DataFrame:
    return rows.select(*SUMMARY, "quality_score", when_text("scraped_at"), *extra)


@register
def search_pages(spark, sf):
    return _summary(search.search_pages(inputs.page_docs(spark, sf), SEARCH, limit=100), "score")


@register
def search_filtered(spark, sf):
    rows = search.search_pages(
        inputs.page_docs(spark, sf), PHRASE_SEARCH, section="en", min_quality=20, limit=20, skip=5
    )
    return _summary(rows, "score")


@register
def search_total(spark, sf):
    return search.search_total(inputs.page_docs(spark, sf), SEARCH)


@register
def search_response(spark, sf):
    pages = inputs.page_docs(spark, sf)
    rows = search.search_pages(pages, SEARCH, section="en", limit=10)
    return search.search_response(rows, SEARCH, section="en").select(
        "query",
        "total_results",
        F.array_join(F.col("results")["url"], "|").alias("urls"),
        F.col("filters")["section"].alias("section"),
    )


@register
def search_postings(spark, sf):
    """The same search from the stored index, as the first crawl left it."""
    pages = prepared.crawl_store(spark, sf)
    rows = pages.index.search(pages.store, SEARCH, limit=100, version=prepared.FIRST)
    return _summary(rows, "score")


@register
def search_postings_last(spark, sf):
    """Words, a phrase and an excluded word, after a second crawl and a removal."""
    pages = prepared.crawl_store(spark, sf)
    rows = pages.index.search(pages.store, INDEX_SEARCH, min_quality=10, limit=100, version=prepared.LAST)
    return _summary(rows, "score")


@register
def postings(spark, sf):
    return (
        search.build_postings(inputs.page_docs(spark, sf))
        .groupBy("term")
        .agg(F.count("*").alias("pages"), F.sum("tf").alias("occurrences"))
    )


@register
def filter_pages(spark, sf):
    return catalog.filter_pages(inputs.page_docs(spark, sf), "en", "t3", 50).select(
        "url", "quality_score"
    )


@register
def list_pages(spark, sf):
    rows = catalog.list_pages(inputs.page_docs(spark, sf), section="en", limit=100, skip=20)
    return _summary(rows, when_text("last_updated"))


@register
def list_pages_seek(spark, sf):
    """The third page of the list, reached by cursors."""
    pages, after = inputs.page_docs(spark, sf), None
    for _ in range(2):
        after = catalog.cursor(catalog.list_pages_after(pages, after, limit=60), catalog.LISTING)
    return _summary(catalog.list_pages_after(pages, after, limit=60), when_text("last_updated"))


@register
def search_pages_seek(spark, sf):
    """The second page of search results, reached by a cursor."""
    pages = inputs.page_docs(spark, sf)
    after = catalog.cursor(search.search_pages_after(pages, SEARCH, limit=25), search.RANKING)
    return _summary(search.search_pages_after(pages, SEARCH, after, limit=25), "score")


@register
def page_by_id(spark, sf):
    pages = inputs.page_docs(spark, sf)
    wanted = pages.agg(F.min("_id")).scalar()
    return catalog.page_by_id(pages, wanted).select(
        "_id", "url", F.col("content.content_hash").alias("content_hash"), "version"
    )


@register
def page_detail(spark, sf):
    """The detail document of every page, arrays joined or counted."""
    pages = catalog.page_detail(extract.extract_pages(inputs.rich_responses(spark, sf)))
    parts = ("headings", "paragraphs", "code_blocks", "images", "links", "tables", "lists")
    return pages.select(
        "_id",
        "url",
        "title",
        "content.content_hash",
        "content.word_count",
        *[F.size(f"content.structured_data.{p}").alias(p) for p in parts],
        when_text("metadata.scraped_at"),
        "metadata.scraping_job_id",
        "metadata.html_lang",
        F.array_join("navigation.breadcrumb", "|").alias("breadcrumb"),
        "navigation.next_page",
        "seo.meta_description",
        "seo.canonical_url",
        F.array_join("search_fields.keywords", "|").alias("keywords"),
        "status",
        "version",
        "accessibility.has_headings",
    )


@register
def page_summary(spark, sf):
    return _summary(catalog.page_summary(inputs.page_docs(spark, sf)))


def _job_row(rows: DataFrame) -> DataFrame:
    return rows.select(
        "_id",
        "job_name",
        "status",
        when_text("start_time"),
        when_text("end_time"),
        "statistics.successfully_scraped",
    )


@register
def list_jobs(spark, sf):
    return _job_row(catalog.list_jobs(inputs.scraping_jobs(spark, sf), limit=5))


@register
def job_by_id(spark, sf):
    return _job_row(catalog.job_by_id(inputs.scraping_jobs(spark, sf), JOB))


@register
def job_errors(spark, sf):
    errors = jobs.error_log(inputs.crawl_events(spark, sf).where(F.col("kind") == "failed"))
    return catalog.job_errors(errors, JOB).select(
        "url", "error_message", when_text("timestamp"), "retry_count"
    )


@register
def latest_job(spark, sf):
    return _job_row(catalog.latest_job(inputs.scraping_jobs(spark, sf)))


# Aggregations


@register
def site_structure(spark, sf):
    return catalog.site_structure(inputs.page_docs(spark, sf)).select(
        "section", "subsection", "page_count", rounded("avg_quality", "avg_quality")
    )


@register
def structure_pages(spark, sf):
    return catalog.structure_pages(inputs.page_docs(spark, sf))


@register
def section_rollup(spark, sf):
    return _rollup(inputs.page_docs(spark, sf))


def _rollup(pages: DataFrame) -> DataFrame:
    return catalog.section_rollup(pages).withColumn("avg_quality", rounded("avg_quality", "q"))


def _kept_sections(spark: SparkSession, sf: str) -> DataFrame:
    return prepared.crawl_store(spark, sf).store.table(rollups.SECTIONS, prepared.LAST)


@register
def kept_structure(spark, sf):
    """Structure of the site from the roll-up that the store keeps through every commit."""
    return rollups.site_structure(_kept_sections(spark, sf)).withColumn(
        "avg_quality", rounded("avg_quality", "q")
    )


@register
def kept_rollup(spark, sf):
    return rollups.section_lines(_kept_sections(spark, sf)).withColumn(
        "avg_quality", rounded("avg_quality", "q")
    )


@register
def kept_statistics(spark, sf):
    return rollups.content_statistics(_kept_sections(spark, sf)).withColumn(
        "avg_quality_score", F.round("avg_quality_score", 6)
    )


@register
def site_rollup(spark, sf):
    """The roll-up over the crawled pages, scored by the words of their titles."""
    pages = extract.page_parts(inputs.pages_table(spark, sf), title=dom.title())
    url = F.col("url")
    return _rollup(
        pages.select(
            F.struct(
                urls.section(url).alias("section"), urls.subsection(url).alias("subsection")
            ).alias("navigation"),
            text.word_count(F.col("title")).cast("double").alias("quality_score"),
        )
    )


@register
def content_statistics(spark, sf):
    return catalog.content_statistics(inputs.page_docs(spark, sf)).withColumn(
        "avg_quality_score", F.round("avg_quality_score", 6)
    )


@register
def structure_report(spark, sf):
    return catalog.structure_report(inputs.page_docs(spark, sf)).withColumn(
        "avg_quality", F.round("avg_quality", 6)
    )


@register
def statistics_report(spark, sf):
    report = catalog.statistics_report(
        inputs.page_docs(spark, sf), inputs.scraping_jobs(spark, sf)
    )
    return report.select(
        "total_pages",
        "total_words",
        rounded("avg_quality_score", "avg_quality_score"),
        "latest_job.job_name",
        "latest_job.status",
        when_text("latest_job.start_time"),
        "latest_job.statistics.failed_urls",
    )


@register
def job_statistics(spark, sf):
    return jobs.job_statistics(inputs.crawl_events(spark, sf)).withColumn(
        "total_size_mb", F.round("total_size_mb", 6)
    )


@register
def job_progress(spark, sf):
    progress = jobs.job_progress(frontier.status_latest(_transitions(spark, sf)))
    return progress.select(
        "job_id",
        "current_depth",
        "urls_in_queue",
        "urls_being_processed",
        rounded("percentage_complete", "percentage_complete"),
        "status",
        when_text("end_time"),
    )


@register
def complete_jobs(spark, sf):
    """Jobs whose fetches are all over: a queue without its open urls is finished."""
    state = frontier.status_latest(_transitions(spark, sf))
    closed = state.where(
        ~F.col("status").isin("pending", "processing") | (F.col("job_id") > JOB)
    )
    done = jobs.complete_jobs(inputs.scraping_jobs(spark, sf), jobs.job_progress(closed))
    return done.select("_id", "status", when_text("end_time"))


# Maintenance


LIMIT = maintenance.cutoff(NOW, 14)
TORN_LIMIT = datetime(2024, 1, 18, 9, 30)


@register
def retention_queue(spark, sf):
    return maintenance.retain_queue(inputs.url_queue(spark, sf), LIMIT).select(
        "seq", "status", when_text("discovered_at")
    )


def _days(spark: SparkSession, sf: str) -> tuple[Store, int, int]:
    """Queue and errors kept by day, expired days left out; with the number of rows that went of each."""
    store = Store(spark, scratch(spark))
    tx = store.begin()
    maintenance.keep_queue_by_day(tx, inputs.url_queue(spark, sf))
    errors = jobs.error_log(inputs.crawl_events(spark, sf).where(F.col("kind") == "failed"))
    maintenance.keep_errors_by_day(tx, errors)
    tx.commit()
    tx = store.begin()
    # A limit within a day, so that this day is read and written again.
    queued = maintenance.drop_expired(tx, maintenance.QUEUE_DAYS, "discovered_at", TORN_LIMIT)
    failed = maintenance.drop_expired(tx, maintenance.ERROR_DAYS, "timestamp", TORN_LIMIT)
    tx.commit()
    return store, queued, failed


@register
def retention_queue_days(spark, sf):
    store, _, _ = _days(spark, sf)
    rows = maintenance.kept_rows(store.table(maintenance.QUEUE_DAYS))
    return rows.select("seq", "status", when_text("discovered_at"))


@register
def retention_counts(spark, sf):
    """Rows that went and rows that stay, of queue and errors kept by day."""
    store, queued, failed = _days(spark, sf)
    counts = [
        store.table(name).agg(F.lit(name).alias("collection"), F.lit(gone).alias("dropped"), F.count("*").alias("kept"))
        for name, gone in ((maintenance.QUEUE_DAYS, queued), (maintenance.ERROR_DAYS, failed))
    ]
    return counts[0].unionAll(counts[1]).withColumn("dropped", F.col("dropped").cast("long"))


@register
def retention_errors(spark, sf):
    errors = jobs.error_log(inputs.crawl_events(spark, sf).where(F.col("kind") == "failed"))
    return maintenance.retain_errors(errors, LIMIT).select(
        "job_id", "url", when_text("timestamp"), "retry_count"
    )


@register
def pruned_job_errors(spark, sf):
    """Job documents with the old entries of their errors array removed."""
    kept = maintenance.prune_job_errors(inputs.job_documents(spark, sf), LIMIT)
    numbers = F.transform("errors", lambda e: e["seq"].cast("string"))
    return kept.select("_id", F.array_join(numbers, "|").alias("errors"))


@register
def retention_report(spark, sf):
    return maintenance.retention_report(inputs.url_queue(spark, sf), LIMIT)


# Streaming


# Arrivals of a stream: so many files, which are so many micro-batches.
ARRIVALS = 4


def _stream(rows: DataFrame, order: str, folder: str) -> DataFrame:
    """Rows as a stream of several micro-batches, dealt to files by ``order``, earliest first."""
    shares = [k / ARRIVALS for k in range(1, ARRIVALS)]
    bounds = rows.agg(F.percentile_approx(F.col(order).cast("double"), shares)).first()[0] or []
    part = sum((F.when(F.col(order).cast("double") > b, 1).otherwise(0) for b in bounds), start=F.lit(0))
    for k in range(ARRIVALS):
        # Files are read in the order of their times, so each is written by a job of its own.
        rows.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@register
def stream_ingest(spark, sf):
    run = scratch(spark)
    pages = _stream(inputs.pages_table(spark, sf), "page_id", f"{run}/in")
    query = streams.ingest_pages(inputs.lift_raw_pages(pages), f"{run}/log", f"{run}/checkpoint")
    query.awaitTermination()
    return page_digest(streams.current_pages(spark, f"{run}/log"))


@register
def stream_versions(spark, sf):
    """Pages fetched three times, a third of them changed and changed back: versions and first sights."""
    run = scratch(spark)
    pages = inputs.pages_table(spark, sf)
    crawl = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("crawl")
    changed = (F.col("crawl") == 1) & (F.col("page_id") % 3 == 0)
    fetched = inputs.lift_raw_pages(pages.select("*", crawl), "crawl", "page_id")
    fetched = fetched.withColumns(
        {
            "html": F.when(changed, F.concat("html", F.lit("<p>changed</p>"))).otherwise(F.col("html")),
            "fetched_at": F.timestamp_add("DAY", F.col("crawl") * 100, F.col("fetched_at")),
        }
    )
    raw = _stream(fetched, "fetched_at", f"{run}/in")
    streams.ingest_pages(raw, f"{run}/log", f"{run}/checkpoint").awaitTermination()
    current = streams.current_pages(spark, f"{run}/log")
    return current.select("url", "version", when_text("metadata.scraped_at"), when_text("metadata.last_updated"))


@register
def stream_frontier(spark, sf):
    run = scratch(spark)
    candidates = _candidate_stream(spark, sf, run)
    streams.ingest_frontier(candidates, f"{run}/queue", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/queue").select(
        "job_id", "normalized_url", "url", when_text("discovered_at")
    )


def _candidate_stream(spark: SparkSession, sf: str, run: str) -> DataFrame:
    events = inputs.events_table(spark, sf).select(
        inputs._job_id().alias("job_id"),
        inputs._event_url().alias("url"),
        F.col("ts").cast("timestamp").alias("discovered_at"),
    )
    return _stream(events, "discovered_at", f"{run}/in")


@register
def stream_frontier_watermark(spark, sf):
    """Keys of the queue by the watermark form, which remembers a key for a day."""
    run = scratch(spark)
    query = streams.ingest_frontier_within(
        _candidate_stream(spark, sf, run), f"{run}/queue", f"{run}/checkpoint"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{run}/queue").select("job_id", "normalized_url").distinct()


@register
def stream_job_stats(spark, sf):
    run = scratch(spark)
    events = _stream(inputs.events_table(spark, sf), "event_id", f"{run}/in")
    events = inputs.lift_crawl_events(events)
    streams.live_job_statistics(events, f"{run}/stats", f"{run}/checkpoint").awaitTermination()
    return streams.current_statistics(spark, f"{run}/stats").withColumn(
        "total_size_mb", F.round("total_size_mb", 6)
    )
