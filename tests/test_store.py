"""Dedup, upsert, validation, jobs, maintenance, catalog, search, sinks and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import text, urls
from pageloom.operators import dedup, extract, jobs, maintenance, validate
from pageloom.plans import catalog, search
from pageloom.sources import collections as store
from pageloom.sources import raw as raw_source
from pageloom.streaming import streams

AT = datetime(2024, 1, 1)


def pages(spark, *rows):
    """(url, text, minutes) as stored pages."""
    frame = spark.createDataFrame(
        [(u, t, AT + timedelta(minutes=m)) for u, t, m in rows], "url string, t string, at timestamp"
    )
    t = F.col("t")
    return frame.select(
        urls.page_id(F.col("url")).alias("_id"),
        "url",
        F.concat(F.lit("Title "), "t").alias("title"),
        F.struct(
            t.alias("clean_text"),
            text.content_hash(t).alias("content_hash"),
            text.word_count(t).alias("word_count"),
            text.reading_time(text.word_count(t)).alias("reading_time"),
        ).alias("content"),
        F.struct(F.col("at").alias("scraped_at"), F.col("at").alias("last_updated")).alias("metadata"),
        F.struct(
            urls.section(F.col("url")).alias("section"),
            urls.subsection(F.col("url")).alias("subsection"),
        ).alias("navigation"),
        F.struct(text.keywords(t).alias("keywords")).alias("search_fields"),
        F.lit(1).alias("version"),
        F.length("t").cast("double").alias("quality_score"),
    )


def state(frame):
    return {
        r.url: (r.content.clean_text, r.version, r.metadata.scraped_at.minute, r.metadata.last_updated.minute)
        for r in frame.collect()
    }


def test_upsert(spark):
    current = pages(spark, ("a", "one", 1), ("b", "two", 2), ("c", "three", 3))
    batch = pages(spark, ("a", "one", 11), ("b", "TWO", 12), ("d", "four", 13), ("b", "older", 5))
    once = dedup.upsert_pages(current, batch)
    expected = {
        "a": ("one", 1, 1, 1),
        "b": ("TWO", 2, 2, 12),
        "c": ("three", 1, 3, 3),
        "d": ("four", 1, 13, 13),
    }
    assert state(once) == expected
    assert state(dedup.upsert_pages(once, batch)) == expected


def test_dedup_and_groups(spark):
    stored = pages(spark, ("a", "same", 2), ("b", "same", 1), ("c", "same", 1), ("d", "own", 0))
    assert sorted(r.url for r in dedup.dedup_content(stored).collect()) == ["b", "d"]
    groups = dedup.duplicate_groups(stored).collect()
    assert [(g.copies, g.kept_url) for g in groups] == [(3, "b")]


def test_changed_pages(spark):
    current = pages(spark, ("a", "one", 1), ("b", "two", 2))
    batch = pages(spark, ("a", "one", 9), ("b", "2", 9), ("c", "one", 9))
    assert sorted(r.url for r in dedup.changed_pages(batch, current).collect()) == ["b", "c"]


def test_one_per_key(spark):
    rows = spark.createDataFrame([("u", 2, "x"), ("u", 1, "y"), ("v", 3, None)], "url string, n int, t string")
    kept = validate.one_per_key(rows, ["url"], ["n"])
    assert sorted(map(tuple, kept.collect())) == [("u", 1, "y"), ("v", 3, None)]
    assert validate.key_violations(rows, ("url",)).collect()[0]["rows"] == 2
    assert validate.key_violations(kept, ("url",)).isEmpty()


def test_page_rules(spark):
    row = ("http://a.com/x", "<title>t</title><img src='/i.png'>", 200, "text/html", {}, 0.5, AT, "j", 0, None)
    good = extract.extract_pages(spark.createDataFrame([row], schemas.RAW_PAGES))
    assert validate.validate_pages(good).first().violations == []
    broken = good.withColumns(
        {
            "url": F.lit("not a url"),
            "title": F.lit(None).cast("string"),
            "navigation": F.col("navigation").withField("page_type", F.lit("story")),
        }
    )
    checked = validate.validate_pages(good.unionByName(broken))
    assert validate.good_rows(checked).count() == 1
    assert validate.rejected_rows(checked).first().violations == [
        "title: required",
        "url: not an http url",
        "navigation.page_type: unknown",
    ]
    relative = validate.validate_pages(
        extract.extract_pages(
            spark.createDataFrame([("http://a.com/y", "<img src='i.png'>", *row[2:])], schemas.RAW_PAGES)
        )
    )
    assert relative.first().violations == ["images.src: not an http url"]


def test_job_lifecycle(spark):
    starts = spark.createDataFrame(
        [("j1", ["http://a.com"], ["a.com"])],
        "job_id string, start_urls array<string>, allowed_domains array<string>",
    )
    opened = jobs.open_jobs(starts, jobs.CrawlConfig(max_depth=3), AT, "site")
    assert opened.schema.simpleString() == schemas.SCRAPING_JOBS.simpleString()
    row = opened.first()
    assert (row.job_name, row.status, row.configuration.max_depth) == (
        "site_scrape_20240101_000000", "running", 3,
    )
    assert tuple(row.statistics) == (0, 0, 0, 0, 0, 0.0) and row.errors == []
    assert validate.validate_jobs(opened).first().violations == []

    def queue(*statuses):
        return spark.createDataFrame(
            [("j1", f"u{i}", s, AT + timedelta(hours=i), i) for i, s in enumerate(statuses)],
            "job_id string, url string, status string, updated_at timestamp, depth int",
        )

    busy = jobs.job_progress(queue("completed", "pending", "processing", "failed"))
    assert tuple(busy.first())[1:6] == (3, 1, 1, 50.0, "running")
    assert jobs.complete_jobs(opened, busy).first().status == "running"
    done = jobs.job_progress(queue("completed", "skipped"))
    closed = jobs.complete_jobs(opened, done).first()
    assert (closed.status, closed.end_time) == ("completed", AT + timedelta(hours=1))


def test_job_counters(spark):
    rows = [
        ("j", "u", kind, AT, i, 0, 1048576, 0, None)
        for i, kind in enumerate(["discovered", "discovered", "scraped", "failed", "duplicate", "processed"])
    ]
    stats = jobs.job_statistics(spark.createDataFrame(rows, schemas.CRAWL_EVENTS)).first()
    assert tuple(stats) == ("j", 2, 1, 1, 1, 1, 1.0)


def test_retention(spark):
    limit = maintenance.cutoff(AT, 30)
    second = timedelta(seconds=1)
    rows = [
        ("old", "completed", limit - second),
        ("at-limit", "completed", limit),
        ("old-pending", "pending", limit - second),
        ("old-null", None, limit - second),
        ("undated", "failed", None),
        ("old-failed", "failed", limit - second),
    ]
    queue = spark.createDataFrame(rows, "url string, status string, discovered_at timestamp")
    kept = maintenance.retain_queue(queue, limit)
    assert sorted(r.url for r in kept.collect()) == ["at-limit", "old-null", "old-pending", "undated"]
    report = maintenance.retention_report(queue, limit).first()
    assert tuple(report) == (2, "2023-12-02T00:00:00")
    assert report.deleted_queue_entries + kept.count() == queue.count()
    error = ("u", "t", "m", 0, limit - second, 1)
    job = spark.createDataFrame(
        [("j1", [error, (*error[:4], limit, 2)]), ("j2", []), ("j3", None)],
        "_id string, errors array<struct<url:string,error_type:string,error_message:string,"
        "status_code:int,timestamp:timestamp,retry_count:int>>",
    )
    pruned = {r._id: r.errors for r in maintenance.prune_job_errors(job, limit).collect()}
    assert [e.retry_count for e in pruned["j1"]] == [2]
    assert pruned["j2"] == [] and pruned["j3"] is None


SITE = (
    ("http://a.com/", "root page", 1),
    ("http://a.com/docs", "docs index", 2),
    ("http://a.com/docs/x", "deep cat cat", 3),
    ("http://a.com/docs/x/1", "a cat of the dog", 4),
    ("http://a.com/root", "named root cats", 5),
    ("http://a.com/art", "part art apart art_ 1art arts part-art", 6),
)


def test_rollup_agrees_with_totals(spark):
    stored = pages(spark, *SITE)
    rollup = {(r.level, r.section, r.subsection): r for r in catalog.section_rollup(stored).collect()}
    assert set(rollup) == {
        ("section", "root", ""), ("section", "docs", ""), ("subsection", "docs", "x"),
        ("section", "art", ""),
    }
    docs = rollup["section", "docs", ""]
    assert (docs.page_count, docs.subsections) == (3, 1)
    assert docs.avg_quality == pytest.approx((10 + 12 + 16) / 3)
    totals = catalog.content_statistics(stored).first()
    assert totals.total_pages == sum(r.page_count for k, r in rollup.items() if k[0] == "section")
    report = {(r.level, r.section): r for r in catalog.structure_report(stored).collect()}
    assert report["site", ""].words == totals.total_words
    assert report["site", ""].avg_quality == pytest.approx(totals.avg_quality_score)


def test_empty_tables(spark):
    none = pages(spark, *SITE).where(F.lit(False))
    assert tuple(catalog.content_statistics(none).first()) == (0, 0, 0.0)
    assert catalog.section_rollup(none).isEmpty()
    assert [tuple(r) for r in catalog.structure_report(none).collect()] == [("site", "", "", 0, 0, 0.0)]
    assert search.search_pages(none, "cat").isEmpty()
    no_jobs = spark.createDataFrame([], schemas.SCRAPING_JOBS)
    report = catalog.statistics_report(none, no_jobs).first()
    assert report.total_pages == 0 and report.latest_job is None


def test_listing(spark):
    stored = pages(spark, *SITE)
    rows = catalog.list_pages(stored, section="docs", limit=2, skip=1).collect()
    assert [r.url[-6:] for r in rows] == ["docs/x", "m/docs"]
    assert catalog.list_pages(stored, section="", min_quality=0).count() == 6
    assert catalog.filter_pages(stored, subsection="x", min_quality=13).count() == 1
    for limit, skip in ((0, 0), (101, 0), (1, -1)):
        with pytest.raises(ValueError):
            catalog.list_pages(stored, limit=limit, skip=skip)
    plan = catalog.list_pages(stored)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert catalog.page_detail(
        extract.extract_pages(spark.createDataFrame([], schemas.RAW_PAGES))
    ).columns == schemas.PAGES.names


QUERIES = ["cat", "CAT", "cat dog", '"cat of"', "cat -dog", "the", "", '"a cat" -deep', "zebra", "root cats", "art part", "part art arts -cat", "index -art"]


@pytest.mark.parametrize("q", QUERIES)
def test_search_against_brute_force(spark, q):
    import re

    wanted = search.search_terms(q)
    expected = []
    for url, body, _ in SITE:
        fields = [body, "Title " + body]
        words = [w for f in fields for w in re.findall(r"\w+", f.lower())]
        words += [w for w in dict.fromkeys(re.findall(r"[a-z]{2,}", body)) if w not in text.STOP_WORDS]
        score = sum(w in wanted.any_of for w in words)
        fits = all(any(p in f.lower() for f in fields) for p in wanted.phrases)
        if score and fits and not set(words) & set(wanted.none_of):
            expected.append((url, score))
    expected.sort(key=lambda hit: (-hit[1], hit[0]))
    stored = pages(spark, *SITE)
    assert [(r.url, r.score) for r in search.search_pages(stored, q).collect()] == expected
    by_postings = search.search_postings(search.build_postings(stored), stored, q)
    assert [(r.url, r.score) for r in by_postings.collect()] == expected
    total = search.search_total(stored, q).first().total_matches
    assert total == len(expected)
    response = search.search_response(search.search_pages(stored, q), q).first()
    assert response.total_results == len(expected)
    assert [r.url for r in response.results] == [u for u, _ in expected]


def test_search_terms():
    assert search.search_terms('The cat -dog "big red" x-ray') == search.SearchTerms(
        ("cat", "x", "ray", "big", "red"), ("dog",), ("big red",)
    )


def test_postings_prune_by_term(spark, tmp_path):
    path = str(tmp_path / "postings")
    search.write_postings(search.build_postings(pages(spark, *SITE)), path, 3)
    hit = spark.read.parquet(path).where(F.col("term") == "cat")
    assert hit.count() == 2
    assert "EqualTo(term,cat)" in hit._jdf.queryExecution().executedPlan().toString()


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "pages")
    first = pages(spark, ("http://a.com/1", "one", 1))
    with pytest.raises(FileNotFoundError):
        store.read_snapshot(spark, root)
    store.write_snapshot(first, root)
    batch = pages(spark, ("http://a.com/1", "uno", 2), ("http://a.com/2", "due", 2))
    for _ in range(2):
        store.write_snapshot(dedup.upsert_pages(store.read_snapshot(spark, root), batch), root)
    assert {u: s[1] for u, s in state(store.read_snapshot(spark, root)).items()} == {
        "http://a.com/1": 2, "http://a.com/2": 1,
    }
    (tmp_path / "pages" / "snapshot-00000009").mkdir()
    assert len(state(store.read_snapshot(spark, root))) == 2


def test_named_table_prunes(spark):
    stored = pages(spark, *SITE)
    store.save_table(stored, "pages", files=2)
    loaded = store.load_table(spark, "pages")
    assert state(loaded) == state(stored)
    rows = catalog.list_pages(loaded, section="docs", min_quality=1)
    plan = rows._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(navigation.section,docs)" in pushed
    assert "GreaterThanOrEqual(quality_score,1.0)" in pushed
    assert "clean_text" not in next(x for x in plan.splitlines() if x.startswith("ReadSchema"))


def raw_rows(spark, *rows):
    return spark.createDataFrame(
        [(u, h, 200, "text/html", {"etag": "e"}, 0.1, AT + timedelta(minutes=m), "j", 0, None) for u, h, m in rows],
        schemas.RAW_PAGES,
    )


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_ingest_stream_equals_batch(spark, tmp_path, fmt):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    batches = [
        [("http://a.com/1", "<p>one</p>", 1), ("http://a.com/2", "<p>two</p>", 1)],
        [("http://a.com/1", "<p>one</p>", 2), ("http://a.com/2", "<p>TWO</p>", 2), ("http://a.com/3", "x", 2)],
        [("http://a.com/2", "<p>two</p>", 3)],
    ]
    table = None
    for rows in batches:
        raw = raw_rows(spark, *rows)
        raw.coalesce(1).write.mode("append").format(fmt).save(source)
        stream = raw_source.stream_raw_pages(spark, source, fmt, max_files_per_trigger=1)
        streams.ingest_pages(stream, log, str(tmp_path / "checkpoint")).awaitTermination()
        new = extract.extract_pages(raw)
        table = new if table is None else dedup.upsert_pages(table, new)
    assert state(streams.current_pages(spark, log)) == state(table)
    assert raw_source.read_raw_pages(spark, source, fmt).count() == 6
    versions = {u: s[1] for u, s in state(table).items()}
    assert versions == {"http://a.com/1": 1, "http://a.com/2": 3, "http://a.com/3": 1}


def _forget_commit(checkpoint, batch):
    """As after a crash between a batch's output and its commit: the batch runs again."""
    for name in (f"{batch}", f".{batch}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    source, log, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), tmp_path / "checkpoint"

    def run():
        stream = raw_source.stream_raw_pages(spark, source, max_files_per_trigger=1)
        streams.ingest_pages(stream, log, str(checkpoint)).awaitTermination()

    for text, minute in (("one", 1), ("two", 2)):
        raw_rows(spark, ("http://a.com/1", f"<p>{text}</p>", minute)).coalesce(1).write.mode("append").parquet(source)
        run()
    for _ in range(2):
        _forget_commit(checkpoint, 1)
        run()
        assert state(streams.current_pages(spark, log)) == {"http://a.com/1": ("two", 2, 1, 2)}


def test_ingest_does_not_read_earlier_batches(spark, tmp_path):
    """The log of earlier batches may even be gone: what is remembered is keyed state."""
    import shutil

    source, log = str(tmp_path / "in"), tmp_path / "log"
    for minute, text in enumerate(["one", "two", "two", "one"]):
        rows = [("http://a.com/1", f"<p>{text}</p>", minute), (f"http://a.com/new{minute}", "<p>x</p>", minute)]
        raw_rows(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = raw_source.stream_raw_pages(spark, source, max_files_per_trigger=1)
        streams.ingest_pages(stream, str(log), str(tmp_path / "checkpoint")).awaitTermination()
        written = spark.read.parquet(f"{log}/batch_id={minute}")
        found = {r.url: (r.version, r.metadata.scraped_at.minute) for r in written.collect()}
        expected = {f"http://a.com/new{minute}": (1, minute)}
        if text != (["", "one", "two", "two"][minute]):
            expected["http://a.com/1"] = ([1, 2, 2, 3][minute], 0)
        assert found == expected
        shutil.rmtree(log / f"batch_id={minute}")


def test_stream_keeps_every_column_of_a_page(spark, tmp_path):
    html = (
        "<html lang='de'><head><title>é \\ \" </title><meta name='keywords' content='a, b,'></head><body><h1 id='x'>H</h1>"
        "<p>some words long enough</p><pre><code class='language-py'>x\n\t1</code></pre><img src='/i.png' alt='a'>"
        "<table><tr><th>a</th></tr><tr><td></td></tr></table><ul><li>one</li></ul><a href='/n'>next</a></body></html>"
    )
    raw = raw_rows(spark, ("http://a.com/1", html, 1), ("http://a.com/2", "", 2))
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    raw.coalesce(1).write.parquet(source)
    streams.ingest_pages(raw_source.stream_raw_pages(spark, source), log, str(tmp_path / "c")).awaitTermination()
    pages = extract.extract_pages(raw)
    streamed = streams.current_pages(spark, log).select(*pages.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, pages.collect()))


def test_frontier_stream_keeps_first_sights_without_the_queue(spark, tmp_path):
    import shutil

    source, queue, checkpoint = str(tmp_path / "in"), tmp_path / "queue", tmp_path / "c"
    minutes = [[("a", 5), ("b", 3), ("a", 4)], [("A", 1), ("c", 9)], [("c", 2), ("b", 1)]]
    expected = [{("a", 4), ("b", 3)}, {("c", 9)}, set()]
    for n, rows in enumerate(minutes):
        made = [("j", f"http://a.com/{u}", AT + timedelta(minutes=m)) for u, m in rows]
        spark.createDataFrame(made, CANDIDATES).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            stream = spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", 1).parquet(source)
            streams.ingest_frontier(stream, str(queue), str(checkpoint)).awaitTermination()
            got = spark.read.schema("normalized_url string, discovered_at timestamp").parquet(f"{queue}/batch_id={n}")
            assert {(r.normalized_url[-1], r.discovered_at.minute) for r in got.collect()} == expected[n]
            _forget_commit(checkpoint, n)
        shutil.rmtree(queue / f"batch_id={n}")


CANDIDATES = "job_id string, url string, discovered_at timestamp"


def test_frontier_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    files = [
        [("j", "http://A.com/x", AT), ("j", "http://a.com/x", AT), ("k", "http://a.com/x", AT)],
        [("j", "http://a.com/X", AT + timedelta(minutes=1)), ("j", "http://a.com/y", AT)],
    ]
    for rows in files:
        spark.createDataFrame(rows, CANDIDATES).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", 1).parquet(source)

    queue = str(tmp_path / "queue")
    streams.ingest_frontier(stream(), queue, str(tmp_path / "c1")).awaitTermination()
    exact = spark.read.parquet(queue)
    keys = {("j", "http://a.com/x"), ("k", "http://a.com/x"), ("j", "http://a.com/y")}
    assert {(r.job_id, r.normalized_url) for r in exact.collect()} == keys
    assert exact.count() == 3

    query = (
        streams.frontier_within(stream())
        .writeStream.format("memory")
        .queryName("within")
        .option("checkpointLocation", str(tmp_path / "c2"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    within = spark.table("within")
    assert {(r.job_id, r.normalized_url) for r in within.collect()} == keys and within.count() == 3


def test_live_counters(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [
        ("j%d" % (i % 2), "u", ["discovered", "scraped"][i % 3 == 0], AT, i, 0, 2048, 0, None)
        for i in range(20)
    ]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, schemas.CRAWL_EVENTS).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(schemas.CRAWL_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    streams.live_job_statistics(events, out, str(tmp_path / "c")).awaitTermination()
    batch = jobs.job_statistics(spark.createDataFrame(rows, schemas.CRAWL_EVENTS))
    live = streams.current_statistics(spark, out).select(*batch.columns)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_counters_are_read_from_one_snapshot_and_few_changes(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "c"
    seen = []
    for n in range(7):
        rows = [(f"j{(n + k) % 4}", "u", "scraped", AT, n * 3 + k, 0, 1024, 0, None) for k in range(3)]
        seen += rows
        spark.createDataFrame(rows, schemas.CRAWL_EVENTS).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            events = spark.readStream.schema(schemas.CRAWL_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
            streams.live_job_statistics(events, out, str(checkpoint), every=3).awaitTermination()
            folders = streams.statistics_folders(spark, out)
            assert len(folders) <= 3 and ("snapshots" in folders[0]) == (n >= 2)
            batch = jobs.job_statistics(spark.createDataFrame(seen, schemas.CRAWL_EVENTS))
            live = streams.current_statistics(spark, out).select(*batch.columns)
            assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
            _forget_commit(checkpoint, n)


def test_result_does_not_depend_on_partitions(spark):
    rows = [(f"http://a.com/{i}", f"<title>{i}</title><p>some text number {i}</p>", i) for i in range(30)]
    raw = raw_rows(spark, *rows)
    one = extract.extract_pages(raw.coalesce(1)).orderBy("url").collect()
    many = extract.extract_pages(raw.repartition(7)).orderBy("url").collect()
    assert one == many
