"""The page store: commits, copy-on-write by bucket, kept roll-ups and the stored index."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom.functions import text, urls
from pageloom.operators import dedup, maintenance, rollups
from pageloom.operators.saving import PageStore
from pageloom.plans import catalog, search, textindex
from pageloom.plans.textindex import TextIndex
from pageloom.sources.store import BUCKET, FOLDER, Conflict, Store

AT = datetime(2024, 1, 1)
NONE = "url string, title string, t string, at timestamp, section string, subsection string, quality double"


def pages(spark, rows):
    """Stored pages from (url, title, text, minutes, section, subsection, quality)."""
    frame = spark.createDataFrame([(u, h, t, AT + timedelta(minutes=m), a, b, q) for u, h, t, m, a, b, q in rows], NONE)
    t = F.col("t")
    return frame.select(
        urls.page_id(F.col("url")).alias("_id"),
        "url",
        "title",
        F.struct(
            t.alias("clean_text"),
            text.content_hash(t).alias("content_hash"),
            text.word_count(t).alias("word_count"),
            text.reading_time(text.word_count(t)).alias("reading_time"),
        ).alias("content"),
        F.struct(F.col("at").alias("scraped_at"), F.col("at").alias("last_updated")).alias("metadata"),
        F.struct("section", "subsection").alias("navigation"),
        F.struct(text.keywords(t).alias("keywords")).alias("search_fields"),
        F.lit(1).alias("version"),
        F.col("quality").alias("quality_score"),
    )


def some(n, start=0, words="alpha beta"):
    return [(f"http://a.com/{k}", f"Title {k}", f"{words} {k}", k % 50, f"s{k % 3}", "", float(k % 7)) for k in range(start, start + n)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_few_buckets_are_written_again(spark, store):
    saved = PageStore(store, buckets=32, indexed=False)
    first = saved.save(pages(spark, some(1000)))
    assert (first.version, first.added, first.changed) == (1, 1000, 0) and len(first.buckets) == 32
    # One hundredth of the pages, all in three buckets, comes again: half of them changed.
    chosen = [1, 5, 9]
    ids = saved.store.rows(store.record(), "pages", chosen).select("url").limit(10).collect()
    numbers = [int(r.url.rsplit("/", 1)[1]) for r in ids]
    batch = [some(1, k, "alpha beta" if i % 2 else "new words")[0] for i, k in enumerate(numbers)]
    before = saved.pages().collect()
    second = saved.save(pages(spark, batch))
    assert (second.added, second.changed, second.removed) == (0, 5, 0)
    assert set(second.buckets) <= set(chosen)
    assert second.page_bytes < first.page_bytes * 4 / 32
    kept = store.record(1)["tables"]["pages"]["files"]
    now = store.record(2)["tables"]["pages"]["files"]
    assert {int(b) for b in now if now[b] != kept.get(b)} == set(second.buckets)
    assert sorted(map(str, saved.pages(1).collect())) == sorted(map(str, before))
    expected = dedup.upsert_pages(saved.pages(1), pages(spark, batch))
    assert rows(saved.pages()) == rows(expected)


def test_unchanged_batch_writes_no_pages(spark, store):
    saved = PageStore(store, buckets=8)
    saved.save(pages(spark, some(40)))
    again = saved.save(pages(spark, some(40)))
    assert (again.added, again.changed, again.buckets, again.page_bytes) == (0, 0, (), 0)
    assert store.record(2)["tables"] == store.record(1)["tables"]
    assert saved.save(pages(spark, [])).version == 3
    assert saved.pages().count() == 40


def test_any_sequence_of_saves_equals_upserts_and_fresh_rollups(spark, store):
    rng = random.Random(11)
    saved, state = PageStore(store, buckets=8, indexed=False), None
    for step in range(5):
        batch = []
        for _ in range(60):
            k = rng.randrange(80)
            section = rng.choice(["", None, "docs", "blog"])
            batch.append((f"http://a.com/{k}", "T", f"text {rng.randrange(3)}", step * 100 + rng.randrange(50), section, rng.choice(["", "x"]), rng.choice([None, 1.5, 70.25])))
        batch = pages(spark, batch)
        state = dedup.latest_per_url(batch).select(*batch.columns) if state is None else dedup.upsert_pages(state, batch)
        state = spark.createDataFrame(state.collect(), state.schema)
        saved.save(batch)
        if step == 3:
            gone = state.where(F.col("url").endswith("7") | F.col("url").endswith("1"))
            saved.delete(gone)
            state = spark.createDataFrame(state.join(gone.select("_id"), "_id", "left_anti").select(*state.columns).collect(), state.schema)
        assert rows(saved.pages().select(*state.columns)) == rows(state)
        kept = store.table(rollups.SECTIONS)
        fresh = catalog.site_structure(state)
        assert rows(rollups.site_structure(kept)) == rows(fresh.select("section", "subsection", "page_count", "avg_quality"))
        assert rows(rollups.content_statistics(kept)) == rows(catalog.content_statistics(state))


def test_rollups_do_not_read_pages(spark, store):
    saved = PageStore(store, buckets=4, indexed=False)
    saved.save(pages(spark, some(20)))
    read = rollups.section_lines(store.table(rollups.SECTIONS)).inputFiles()
    assert read and all("/data/sections/" in f for f in read)


def test_second_writer_is_refused(spark, store):
    saved = PageStore(store, buckets=4, indexed=False)
    saved.save(pages(spark, some(5)))
    late, early = store.begin(), store.begin()
    for tx in (late, early):
        tx.put("jobs", spark.createDataFrame([(1, "a")], "id int, name string"), ["id"], 2)
    early.commit()
    with pytest.raises(Conflict):
        late.commit()
    assert store.versions() == [1, 2] and store.table("jobs").count() == 1


def test_a_crash_between_tables_shows_nothing(spark, store):
    """Pages are written and the writer dies before the jobs: readers still see both as they were."""
    jobs = spark.createDataFrame([(1, "running")], "id int, status string")
    saved = PageStore(store, buckets=4, indexed=False)
    saved.save(pages(spark, some(5)), {"jobs": (jobs, ("id",))})

    class Dies(RuntimeError):
        pass

    def broken(_rows):
        raise Dies

    done = jobs.withColumn("status", F.lit("completed"))
    tx = store.begin()
    tx.replace_buckets("pages", tx.rows("pages").withColumn("title", F.lit("half")), range(4))
    with pytest.raises(Dies):
        tx.put("jobs", broken(done), ["id"], 2)
    assert {r.title for r in store.table("pages").collect()} == {f"Title {k}" for k in range(5)}
    assert [r.status for r in store.table("jobs").collect()] == ["running"]
    # The next writer takes the same version; vacuum removes what the dead one left.
    saved.save(pages(spark, some(3, 100)), {"jobs": (done, ("id",))})
    assert store.table("pages").count() == 8 and store.table("jobs").first().status == "completed"
    dropped = store.vacuum(keep=1)
    assert any(d.startswith("pages/") for d in dropped)
    assert store.versions() == [2] and store.table("pages").count() == 8


def test_rows_outside_the_buckets_are_refused(spark, store):
    tx = store.begin()
    tx.put("t", spark.range(100), ["id"], 8)
    with pytest.raises(ValueError, match="outside"):
        tx.replace_buckets("t", spark.range(100), [0])


def test_lookup_reads_one_bucket(spark, store):
    saved = PageStore(store, buckets=16)
    saved.save(pages(spark, some(200)))
    for k in (0, 17, 199):
        wanted = pages(spark, some(1, k)).first()._id
        found = store.lookup("pages", [wanted])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{BUCKET}=") <= 1 and "InMemoryFileIndex(1 paths)" in plan
        assert "EqualTo(_id," in plan
        assert [r.url for r in found.collect()] == [f"http://a.com/{k}"]
    assert store.lookup("pages", ["none"]).collect() == []


def test_lookup_uses_bloom_filters(spark, store):
    """Every file has a Bloom filter on its key: the footer of a file says where it lies."""
    PageStore(store, buckets=2, indexed=False).save(pages(spark, some(50)))
    files = store.table("pages").inputFiles()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for file in files:
        source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(hadoop(file), conf)
        reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        for column in reader.getFooter().getBlocks().get(0).getColumns():
            path = column.getPath().toDotString()
            assert (column.getBloomFilterOffset() > 0) == (path == "_id")
            assert path not in (BUCKET, FOLDER)
        reader.close()
    assert files


def test_pages_by_cursor_equal_pages_by_offset(spark):
    """Ties and nulls in every column of the order, up to the end of the list."""
    rng = random.Random(8)
    made = [
        (rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, AT, AT + timedelta(days=1)]), f"u{k:03d}") for k in range(95)
    ]
    rows = spark.createDataFrame(made, "quality_score double, last_updated timestamp, url string").repartition(3)
    order = [F.desc("quality_score"), F.desc("last_updated"), F.asc("url")]
    after, k = None, 0
    while True:
        page = catalog.seek(rows, catalog.LISTING, 10, 100, after)
        assert page.collect() == catalog.paged(rows, order, 10, k, 100).collect()
        after, k = catalog.cursor(page, catalog.LISTING), k + 10
        if after is None:
            break
    assert k == 110


def test_a_cursor_keeps_no_more_rows_than_a_page_and_skips_files(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("quality_score"), F.lit(AT).alias("last_updated"), F.col("id").cast("string").alias("url"))
    rows.repartitionByRange(4, "quality_score").write.parquet(str(tmp_path / "t"))
    deep = catalog.seek(spark.read.parquet(str(tmp_path / "t")), catalog.LISTING, 10, 100, (55.0, AT, "55"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = deep._jdf.queryExecution().explainString(mode)
    assert "Arguments: 10, [quality_score" in plan and "LessThanOrEqual(quality_score,55.0)" in plan
    assert [r.quality_score for r in deep.collect()] == [float(k) for k in range(54, 44, -1)]


WORDS = ["alpha", "beta", "gamma", "of", "the", "then", "proof", "license", "été", "x_1"]


def random_page(rng, k):
    words = [rng.choice(WORDS) for _ in range(rng.randrange(12))]
    body = "".join(w + rng.choice([" ", " ", " ", "  ", ", ", "-", "\n"]) for w in words)
    return (f"http://a.com/{k}", rng.choice(["Of the", "Alpha", "", "proof then"]), body, k, rng.choice(["docs", "blog"]), "", float(rng.randrange(100)))


QUERIES = [
    "alpha beta",
    "alpha -license",
    '"of the"',
    'beta "alpha gamma" -été',
    '"of the" "then" alpha',
    '"alpha, beta" gamma',
    '"x_1 été proof"',
    '"a"',
    "the",
    '"proof of the alpha"',
]


def test_index_equals_scan_through_saves_merges_and_removals(spark, store, monkeypatch):
    monkeypatch.setattr(textindex, "FAN", 2)
    rng = random.Random(5)
    saved = PageStore(store, buckets=4)
    for step in range(4):
        batch = [random_page(rng, rng.randrange(120)) for _ in range(60)]
        batch = list({r[0]: r for r in batch}.values())
        saved.save(pages(spark, batch))
        if step == 2:
            saved.delete(saved.pages().where(F.col("url").endswith("3")))
    record = store.record()
    assert len(record["tables"]["postings"]["files"]) < 4
    for version in (2, record["version"]):
        state = saved.pages(version)
        for q in QUERIES:
            scanned = search.search_pages(state, q, min_quality=10, limit=100).collect()
            found = saved.index.search(store, q, min_quality=10, limit=100, version=version).collect()
            assert [(r.url, r.score) for r in found] == [(r.url, r.score) for r in scanned], q
            assert [r.title for r in found] == [r.title for r in scanned]
    first = saved.index.search(store, "alpha the", section="docs", limit=5, skip=3).collect()
    assert [r.url for r in first] == [r.url for r in search.search_pages(saved.pages(), "alpha the", section="docs", limit=5, skip=3).collect()]


def test_many_words_end_alike(spark, store, monkeypatch):
    """More words than a filter names are met by the condition itself."""
    monkeypatch.setattr(textindex, "NAMED", 3)
    saved = PageStore(store, buckets=2)
    saved.save(pages(spark, [(f"http://a.com/{k}", "", f"w{k}of thea b", 1, "s", "", 1.0) for k in range(20)]))
    found = saved.index.search(store, '"of the" b', limit=100).collect()
    assert len(found) == 20


def test_postings_keep_places_and_fields(spark):
    page = pages(spark, [("http://a.com/1", "Beta", "alpha  beta alpha", 0, "s", "", 1.0)])
    found = {r.term: r.places for r in textindex.positional_postings(page).collect()}
    alpha = [0 << 3, 2 << 3 | 4, 0 << 3 | 2]
    assert sorted(found["alpha"]) == sorted(alpha)
    assert sorted(found["beta"]) == sorted([1 << 3, 0 << 3 | 1, 1 << 3 | 4 | 2])


def test_segments_of_one_size_are_merged(spark, store):
    saved = PageStore(store, buckets=2)
    for step in range(7):
        saved.save(pages(spark, some(10, step * 10)))
    assert len(store.record()["tables"]["entries"]["files"]) <= 4
    assert saved.index.search(store, "alpha", limit=100).count() == 70
    assert isinstance(saved.index, TextIndex)


QUEUE = "seq long, status string, discovered_at timestamp"


@pytest.mark.parametrize("hour", [0, 7])
def test_expired_days_go_without_a_look_at_kept_ones(spark, store, hour):
    rng = random.Random(hour)
    made = [
        (k, rng.choice(["completed", "failed", "pending", None]), rng.choice([None, AT + timedelta(hours=rng.randrange(96))])) for k in range(200)
    ]
    queue = spark.createDataFrame(made, QUEUE)
    tx = store.begin()
    maintenance.keep_queue_by_day(tx, queue)
    tx.commit()
    before = store.record()["tables"][maintenance.QUEUE_DAYS]["files"]
    limit = AT + timedelta(days=2, hours=hour)
    tx = store.begin()
    dropped = maintenance.drop_expired(tx, maintenance.QUEUE_DAYS, "discovered_at", limit)
    tx.commit()
    after = store.record()["tables"][maintenance.QUEUE_DAYS]["files"]
    kept = maintenance.retain_queue(queue, limit)
    assert dropped == 200 - kept.count() > 0
    assert rows(maintenance.kept_rows(store.table(maintenance.QUEUE_DAYS))) == rows(kept)
    written = set(after) - set(before)
    assert len(written) == (1 if hour else 0)
    assert all("__closed=true/__day=2024-01-03" in p for p in written)
    assert rows(maintenance.kept_rows(store.table(maintenance.QUEUE_DAYS, 1))) == rows(queue)
    gone = store.vacuum(keep=1)
    assert sum("__closed=true" in p for p in gone) == (3 if hour else 2)
    assert rows(maintenance.kept_rows(store.table(maintenance.QUEUE_DAYS))) == rows(kept)


def _blocks(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_a_commit_leaves_no_shuffles_and_small_filters(spark, store):
    saved = PageStore(store, buckets=16)
    before = _blocks(spark)
    saved.save(pages(spark, some(200)))
    saved.save(pages(spark, some(100, words="other words")))
    for _ in range(50):  # files go in the background
        if _blocks(spark) <= before:
            break
        time.sleep(0.2)
    assert _blocks(spark) <= before
    # Twice 16 buckets with a filter of a megabyte each would be 32 MB.
    assert store.files.bytes("data") < 8_000_000


def test_postings_move_as_texts(spark, store, monkeypatch):
    monkeypatch.setattr(textindex, "LEAST_BYTES", 1000)
    saved = PageStore(store, buckets=2)
    saved.save(pages(spark, some(300)))
    files = spark.read.parquet(*store.table("postings").inputFiles()).select("_id", "term", F.input_file_name().alias("f"))
    # All words of a page are in one file, and a file is sorted by word.
    assert files.groupBy("_id").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    assert files.select("f").distinct().count() > 1
    one = spark.read.parquet(store.table("postings").inputFiles()[0]).coalesce(1)
    terms = [r["term"] for r in one.select("term").collect()]
    assert terms == sorted(terms)


def test_words_of_a_long_text_cost_linear_time(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    began = time.time()
    found = textindex.positional_postings(pages(spark, [("http://a.com/1", "T", long, 1, "s", "", 1.0)]))
    assert found.select(F.sum(F.size("places"))).first()[0] >= 60_000
    assert time.time() - began < 20


def test_changed_and_removed_pages_are_laid_over_the_stored_ones(spark, store):
    """A commit writes what changed, not the buckets it is in; buckets of many layers become one again."""
    saved = PageStore(store, buckets=2, indexed=False)
    saved.save(pages(spark, some(400)))
    expected = {f"http://a.com/{k}": 1 for k in range(400)}
    for step in range(1, 7):
        if step % 3 == 0:
            done = saved.delete(saved.pages().where(F.col("url").endswith(f"{step}0")))
            expected = {u: v for u, v in expected.items() if not u.endswith(f"{step}0")}
            assert done.removed
        else:
            changed = some(20, step * 20, f"words of {step}")
            batch = changed + changed[:3] + [(None, "", "no url", 1, "s", "", 1.0)]
            done = saved.save(pages(spark, batch))
            for url, *_ in changed:
                expected[url] = expected.get(url, 0) + 1
        assert {r.url: r.version for r in saved.pages().collect()} == expected
        assert max(len(f) for f in store.record()["tables"]["pages"]["files"].values()) <= 4
        if step == 1:
            layers = store.record()["tables"]["pages"]["files"]
            written = {f"{store.root}/data/pages/{FOLDER}={f[-1]}" for f in layers.values()}
            assert spark.read.parquet(*written).count() == 20
    assert {r.url for r in saved.pages(1).collect()} == {f"http://a.com/{k}" for k in range(400)}
    store.vacuum(keep=1)
    assert {r.url: r.version for r in saved.pages().collect()} == expected


def test_a_phrase_moves_no_single_places(spark, store):
    saved = PageStore(store, buckets=2)
    saved.save(pages(spark, [("http://a.com/1", "", "of the " * 500, 1, "s", "", 1.0), ("http://a.com/2", "of", "the of", 1, "s", "", 1.0)]))
    postings = store.rows(store.record(), "postings", marked=True).withColumn("commit", F.lit(1))
    found = textindex.phrase_pages(postings, ["of", "the"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert [r["_id"] for r in found.collect()] == [pages(spark, some(1, 1)).first()._id]
