"""The engine's input tables, derived from the given parquet tables.

Each table is a projection or join of whole given tables; ``oracles`` states the
same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text, urls, words
from pageloom.sources.raw import spread

EPOCH = "2024-01-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes_after_epoch(minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, F.lit(EPOCH).cast("timestamp"))


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "pages"))


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift_raw_pages(pages_table(spark, sf_dir))


def lift_raw_pages(pages: DataFrame, *extra: str) -> DataFrame:
    """Page rows (page_id, url, html) as fetched responses, batch or streaming."""
    pid = F.col("page_id")
    return pages.select(
        *extra,
        "url",
        "html",
        F.when(pid % 20 == 0, 404).when(pid % 20 == 1, 500).otherwise(200).alias("status_code"),
        F.when(pid % 10 == 3, "application/pdf")
        .otherwise("text/html; charset=utf-8")
        .alias("content_type"),
        F.create_map(
            F.lit("etag"),
            F.concat(F.lit("e"), pid.cast("string")),
            F.lit("last-modified"),
            F.date_format(_minutes_after_epoch(pid), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        ).alias("headers"),
        ((pid % 100) / 100.0).alias("response_time"),
        _minutes_after_epoch(pid).alias("fetched_at"),
        F.concat(F.lit("job-"), (pid % 5).cast("string")).alias("job_id"),
        (pid % 4).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("parent_url"),
    )


def doc_url(lang: Column, source: Column, doc_id: Column) -> Column:
    return F.concat(
        F.lit("https://"),
        source,
        F.lit(".example.com/"),
        lang,
        F.lit("/t"),
        (doc_id % 7).cast("string"),
        F.lit("/"),
        doc_id.cast("string"),
    )


def _escape(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as an HTML page that has all page parts."""
    doc, lang, source = F.col("doc_id").cast("string"), F.col("lang"), _escape(F.col("source"))
    lines = F.split("text", "\n")

    def html(*pieces: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    def per_line(body) -> Column:
        return F.array_join(F.transform(lines, body), "")

    page = html(
        '<!DOCTYPE html><html lang="', lang, '"><head><title> ', source, " ", doc, "</title>",
        '<meta name="description" content="About ', source, '">',
        '<meta name="keywords" content="', lang, ", ", source, ',">',
        '<meta property="og:title" content="', source, '">',
        '<meta property="og:description" content="Text ', doc, '">',
        '<meta property="og:image" content="/og/', doc, '.png">',
        '<link rel="canonical" href="', F.col("url"), '"><style>p { margin: 0 }</style></head>',
        '<body><nav><ul><li><a href="/">Skip</a></li></ul></nav>',
        '<div class="breadcrumbs top"><a href="/">Home</a> / <span>', lang, "</span> / ",
        '<a href="/', lang, '"> ', source, " </a><span></span></div>",
        '<main><h1 id="d', doc, '">', source, "</h1><h2>", lang, " <em>", doc, "</em></h2>",
        per_line(lambda line: html("<p>", _escape(line), "</p>\n")),
        '<pre><code class="block language-', lang, '" data-filename="', source, '.txt">',
        _escape(F.col("text")), "</code></pre>",
        '<figure><img src="/img/', doc, '.png" alt="', source, '" title="t', doc, '">',
        "<figcaption> Figure <b>", doc, "</b> </figcaption></figure>",
        '<div><img src="pic.gif"><span class="caption small">In ', lang, "</span></div>",
        "<table><caption>Lines</caption><thead><tr><th>line</th><th>chars</th></tr></thead>",
        F.array_join(
            F.transform(
                lines,
                lambda line, i: html(
                    "<tr><td>", i.cast("string"), "</td><td>", F.length(line).cast("string"),
                    "</td></tr>",
                ),
            ),
            "",
        ),
        "</table>",
        "<ol><li>one<ul><li>", lang, "</li></ul></li><li>", doc, "</li></ol>",
        '<p><a href="../next/', doc, '">Next page</a> <a href="back?d=', doc, '">Go back</a> ',
        '<a href="#top" title="Up">Top</a> <a href="https://Other.example.org/', doc,
        '.pdf">Paper</a><a href="/empty"> </a></p></main>',
        "<footer>Footer</footer></body></html>",
    )
    return documents_table(spark, sf_dir).withColumn(
        "url", doc_url(F.col("lang"), F.col("source"), F.col("doc_id"))
    ).select("doc_id", "url", page.alias("html"))


def rich_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rich pages as fetched responses."""
    return lift_raw_pages(rich_pages(spark, sf_dir).withColumnRenamed("doc_id", "page_id"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents_table(spark, sf_dir).join(labels, "doc_id", "left")


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored pages; title is the first line, score 60 x label + length."""
    nothing = F.struct(F.lit("").alias("text"), F.lit("").alias("url"))
    return _as_pages(labelled_documents(spark, sf_dir).withColumn("added", nothing))


def page_docs_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next crawl: English and French pages changed, German ones the same,
    Spanish ones not fetched again, and every English page has a new sibling."""

    def added(text_added: str, url_added: str = "") -> Column:
        return F.struct(F.lit(text_added).alias("text"), F.lit(url_added).alias("url"))

    fetched = (
        F.when(F.col("lang") == "en", F.array(added(" updated"), added("", "/new")))
        .when(F.col("lang") == "fr", F.array(added(" updated")))
        .when(F.col("lang") == "de", F.array(added("")))
    )
    docs = labelled_documents(spark, sf_dir)
    return _as_pages(docs.withColumn("added", F.explode(fetched)), delay=5000)


def _as_pages(docs: DataFrame, delay: int = 0) -> DataFrame:
    doc_id = F.col("doc_id")
    url = F.concat(doc_url(F.col("lang"), F.col("source"), doc_id), F.col("added.url"))
    at = _minutes_after_epoch(doc_id % 1000 + delay)
    base = docs.select(
        "doc_id",
        "lang",
        "label",
        "n_chars",
        url.alias("url"),
        at.alias("at"),
        F.concat("text", F.col("added.text")).alias("clean_text"),
    )
    clean, found = F.col("clean_text"), words.counted(docs.sparkSession, F.col("clean_text"))
    n_words = found["words"]
    return base.select(
        urls.page_id(F.col("url")).alias("_id"),
        "url",
        F.substring_index(clean, "\n", 1).alias("title"),
        F.struct(
            clean.alias("clean_text"),
            text.content_hash(clean).alias("content_hash"),
            n_words.alias("word_count"),
            text.reading_time(n_words).alias("reading_time"),
        ).alias("content"),
        F.struct(
            F.col("at").alias("scraped_at"),
            F.col("at").alias("last_updated"),
            F.concat(F.lit("job-"), (doc_id % 7).cast("string")).alias("scraping_job_id"),
        ).alias("metadata"),
        F.struct(
            F.when(doc_id % 50 == 0, "").otherwise(F.col("lang")).alias("section"),
            F.when(doc_id % 11 == 0, "")
            .otherwise(F.concat(F.lit("t"), (doc_id % 7).cast("string")))
            .alias("subsection"),
            F.lit("article").alias("page_type"),
        ).alias("navigation"),
        F.struct(found["keywords"].alias("keywords")).alias("search_fields"),
        F.lit("processed").alias("status"),
        F.lit(1).alias("version"),
        (F.coalesce("label", F.lit(0)) * 60 + F.col("n_chars") % 40)
        .cast("double")
        .alias("quality_score"),
    )


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _job_id() -> Column:
    return F.concat(F.lit("job-"), (F.col("user_id") % 7).cast("string"))


def _event_url() -> Column:
    return F.concat(
        F.lit("https://Site"),
        (F.col("user_id") % 10).cast("string"),
        F.lit(".example.com/p/"),
        (F.col("event_id") % 500).cast("string"),
        F.lit("/?b=1&a=2"),
    )


def _choose(column: str, **values: str) -> Column:
    picked = F.lit(None).cast("string")
    for given, value in values.items():
        picked = F.when(F.col(column) == given, value).otherwise(picked)
    return picked


def url_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    return events_table(spark, sf_dir).select(
        _event_url().alias("url"),
        urls.normalize_url(_event_url()).alias("normalized_url"),
        _choose(
            "event_type",
            view="pending",
            click="processing",
            signup="skipped",
            purchase="completed",
            error="failed",
        ).alias("status"),
        (eid % 3 + 1).cast("int").alias("priority"),
        F.col("ts").cast("timestamp").alias("discovered_at"),
        F.lit(None).cast("string").alias("first_seen_on"),
        (eid % 4).cast("int").alias("attempts"),
        _job_id().alias("job_id"),
        (eid % 6).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("parent_url"),
        F.lit("manual").alias("discovery_method"),
        F.lit(0).cast("long").alias("estimated_processing_time"),
        F.when(
            F.col("value") > 20, F.timestamp_add("DAY", F.lit(10), F.col("ts").cast("timestamp"))
        ).alias("next_retry"),
        eid.alias("seq"),
    )


def lift_crawl_events(events: DataFrame) -> DataFrame:
    return events.select(
        _job_id().alias("job_id"),
        _event_url().alias("url"),
        _choose(
            "event_type",
            view="discovered",
            click="processed",
            signup="duplicate",
            purchase="scraped",
            error="failed",
        ).alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 4).cast("int").alias("attempt"),
        F.floor(F.col("value") * 1024).alias("bytes"),
        (F.col("event_id") % 6).cast("int").alias("depth"),
        F.col("props").alias("error_message"),
    )


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift_crawl_events(events_table(spark, sf_dir))


def scraping_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per user group with its counters; status goes by job number."""
    from pageloom.operators.jobs import job_statistics

    events = crawl_events(spark, sf_dir)
    stats = job_statistics(events)
    spans = events.groupBy("job_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time")
    )
    number = F.substring("job_id", 5, 10).cast("int")
    names = F.array(
        *[F.lit(s) for s in ("running", "completed", "failed", "paused", "cancelled")]
    )
    counters = [c for c in stats.columns if c != "job_id"]
    return stats.join(spans, "job_id").select(
        F.col("job_id").alias("_id"),
        F.concat(F.lit("scrape_"), "job_id").alias("job_name"),
        F.lit("full_crawl").alias("job_type"),
        "start_time",
        F.when(number % 5 != 0, F.col("end_time")).alias("end_time"),
        F.get(names, number % 5).alias("status"),
        F.struct(*counters).alias("statistics"),
        F.struct(
            F.lit(0).alias("current_depth"),
            F.col("total_urls_discovered").alias("urls_in_queue"),
            F.lit(0).cast("long").alias("urls_being_processed"),
            F.lit(0.0).alias("percentage_complete"),
        ).alias("progress"),
    )


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job document for every hundred events, its failures in the ``errors`` array."""
    failed = F.when(
        F.col("kind") == "failed", F.struct(F.col("ts").alias("timestamp"), "seq", "error_message")
    )
    return (
        crawl_events(spark, sf_dir)
        .groupBy(F.floor(F.col("seq") / 100).alias("batch"))
        .agg(F.sort_array(F.collect_list(failed)).alias("errors"))
        .select(F.concat(F.lit("job-"), F.col("batch").cast("string")).alias("_id"), "errors")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links per document, to (7d + 1) and (13d + 5) modulo the document count."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.count("*")).scalar()
    targets = F.array(
        F.pmod(F.col("doc_id") * 7 + 1, F.col("n")), F.pmod(F.col("doc_id") * 13 + 5, F.col("n"))
    )
    return docs.withColumn("n", n).select(
        F.col("doc_id").alias("src"), F.explode(targets).alias("dst")
    )


def link_checks(hrefs: DataFrame) -> DataFrame:
    """Check results per href: none for some lengths, 404 for others."""
    size = F.length("href")
    return (
        hrefs.select("href")
        .distinct()
        .where(size % 5 != 0)
        .select("href", F.when(size % 3 == 0, 404).otherwise(200).alias("status_code"))
    )


def robots_rules(spark: SparkSession, sf_dir: str, path_prefix: Column) -> DataFrame:
    """A rule from every page for its host; some rules name one agent only."""
    pid = F.col("page_id")
    return _table(spark, sf_dir, "pages").select(
        urls.netloc(F.col("url")).alias("host"),
        F.when(pid % 4 == 0, "loom").otherwise("*").alias("agent"),
        pid.alias("seq"),
        (pid % 3 == 0).alias("allow"),
        path_prefix.alias("path_prefix"),
    )


def section_prefix() -> Column:
    return F.concat(F.lit("/"), urls.section(F.col("url")), F.lit("/"))


def first_link_prefix() -> Column:
    return F.regexp_extract("html", '<a href="([^"]*)"', 1)
