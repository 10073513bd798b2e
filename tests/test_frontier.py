"""Frontier, links and crawl closure against brute force in Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.operators import frontier, joins, links

NOW = datetime(2024, 1, 10)
RULES = [
    # host, agent, seq, allow, prefix
    ("a.com", "*", 1, True, "/open/"),
    ("a.com", "*", 2, False, "/open/x"),
    ("a.com", "*", 3, False, "/shut"),
    ("b.com", "*", 1, False, "/"),
    ("c.com", "*", 1, False, "/"),
    ("c.com", "loom", 2, False, "/private"),
    ("d.com", "*", 1, False, ""),
    ("e.com", "other", 1, False, "/"),
    ("f.com", "*", 1, False, "/x?secret"),
    ("f.com", "*", 2, True, "/x?secret"),
]


@pytest.mark.parametrize("few", [500, 0])
def test_robots(spark, monkeypatch, few):
    monkeypatch.setattr(frontier, "FEW_RULES", few)
    rules = spark.createDataFrame(RULES, schemas.ROBOTS_RULES)
    expected = {
        "http://a.com/open/x": True,
        "http://a.com/shut/x": False,
        "http://a.com/SHUT": True,
        "http://a.com": True,
        "http://b.com": False,
        "http://b.com/x": False,
        "http://c.com/x": True,
        "http://c.com/private/x": False,
        "http://d.com/x": True,
        "http://e.com/x": True,
        "http://f.com/x?secret=1": False,
        "http://f.com/x?open": True,
        "http://unknown.com/x": True,
    }
    rows = spark.createDataFrame([(u,) for u in expected], "url string")
    got = frontier.robots_allowed(rows, rules, "Loom/2.0").collect()
    assert {r.url: r.robots_ok for r in got} == expected


CANDIDATES = "job_id string, url string, parent_url string, depth int, seq long"


def brute_force(candidates, known, banned):
    """The rules one candidate at a time, in order of arrival."""
    seen, out = set(known), {}
    for job, url, _, _, seq in sorted(candidates, key=lambda c: c[4]):
        key = (job, url.lower())
        if key in seen:
            out[seq] = "duplicate"
        elif any(b in url for b in banned):
            out[seq] = "excluded"
        else:
            seen.add(key)
            out[seq] = "queued"
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_enqueue_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    rng = random.Random(7)
    names = ["u%d" % i for i in range(20)] + ["U%d" % i for i in range(20)]
    candidates = [
        (
            f"j{rng.randrange(2)}",
            "http://a.com/" + ("U1" if hot and rng.random() < 0.4 else rng.choice(names)),
            None,
            1,
            seq,
        )
        for seq in range(400)
    ]
    known = [("j0", "http://a.com/u3"), ("j1", "http://a.com/u4")]
    given = (
        spark.createDataFrame(candidates, CANDIDATES),
        spark.createDataFrame(known, "job_id string, normalized_url string"),
    )
    patterns = ("U[0-7]$", "u9")
    outcomes = frontier.enqueue_outcomes(*given, excluded_patterns=patterns)
    got = {r.seq: r.outcome for r in outcomes.collect()}
    entering = frontier.enqueue(*given, excluded_patterns=patterns).collect()
    assert {r.seq for r in entering} == {s for s, o in got.items() if o == "queued"}
    banned = [f"U{i}" for i in range(8)] + ["u9"]
    # U1 is also a prefix of U10..U19, which the anchored pattern does not exclude.
    expected = brute_force(
        [(j, u + "$", p, d, s) for j, u, p, d, s in candidates],
        {(j, u + "$") for j, u in known},
        [b + "$" for b in banned if b != "u9"] + ["u9$"],
    )
    assert got == expected
    assert set(got.values()) == {"duplicate", "excluded", "queued"}


def test_enqueue_twice_adds_nothing(spark):
    rows = [("j", f"http://a.com/{i % 5}", None, 1, i) for i in range(12)]
    candidates = spark.createDataFrame(rows, CANDIDATES)
    none = spark.createDataFrame([], "job_id string, normalized_url string")
    first = frontier.queue_rows(frontier.enqueue(candidates, none), NOW)
    assert first.count() == 5
    assert first.schema.names == [n for n in schemas.URL_QUEUE.names]
    assert frontier.enqueue(candidates, first).isEmpty()
    again = frontier.enqueue_outcomes(candidates, first)
    assert [r.outcome for r in again.select("outcome").distinct().collect()] == ["duplicate"]


def test_depth_limit(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "url string, depth int")
    got = frontier.followed(rows, max_depth=2).collect()
    assert sorted((r.url, r.depth) for r in got) == [("a", 1), ("b", 2)]


def reach(edges, seeds, limit):
    depth = {s: 0 for s in seeds}
    level = set(seeds)
    d = 0
    while level and (limit is None or d < limit):
        d += 1
        level = {b for a, b in edges if a in level} - set(depth)
        depth.update({n: d for n in level})
    return depth


@pytest.mark.parametrize("limit", [0, 1, 3, None])
@pytest.mark.parametrize("broadcast_rows", [0, 50_000])
def test_closure_against_brute_force(spark, monkeypatch, limit, broadcast_rows):
    monkeypatch.setattr(joins, "SMALL_ROWS", broadcast_rows)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    monkeypatch.setattr(frontier, "SMALL_ROWS", broadcast_rows)
    rng = random.Random(3)
    # Node 0 has a third of all links out, node 9 a third of all links in.
    edges = [(0, rng.randrange(60)) for _ in range(40)]
    edges += [(rng.randrange(60), 9) for _ in range(40)]
    edges += [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    closure = frontier.crawl_closure(
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame([(5,), (6,), (5,)], "node long"),
        limit,
    )
    rows = closure.collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.depth for r in rows} == reach(edges, {5, 6}, limit)


QUEUE = "job_id string, url string, normalized_url string, status string, priority int, discovered_at timestamp, attempts int, next_retry timestamp"


def test_pending_batch(spark):
    early, late = NOW - timedelta(days=1), NOW + timedelta(days=1)
    rows = [
        ("j", "u1", "u1", "pending", 2, early, 0, None),
        ("j", "u2", "u2", "pending", 1, late, 0, None),
        ("j", "u3", "u3", "pending", 1, early, 1, NOW),
        ("j", "u4", "u4", "pending", 1, early, 1, late),
        ("j", "u5", "u5", "failed", 1, early, 0, None),
        ("k", "u6", "u6", "pending", 1, early, 0, None),
    ]
    queue = spark.createDataFrame(rows, QUEUE)
    assert [r.url for r in frontier.pending_batch(queue, NOW, 2, "j").collect()] == ["u3", "u2"]
    every = frontier.pending_batch(queue, NOW, 2)
    assert sorted((r.job_id, r["rank"], r.url) for r in every.collect()) == [
        ("j", 1, "u3"),
        ("j", 2, "u2"),
        ("k", 1, "u6"),
    ]
    assert "WindowGroupLimit" in every._jdf.queryExecution().executedPlan().toString()


def test_retry_schedule(spark):
    rows = [("j", f"u{i}", f"u{i}", "failed", 1, NOW, a, None) for i, a in enumerate((0, 1, 2, None))]
    got = frontier.retry_schedule(spark.createDataFrame(rows, QUEUE), NOW).orderBy("url").collect()
    assert [(r.attempts, r.status, r.next_retry) for r in got] == [
        (1, "pending", NOW + timedelta(seconds=10)),
        (2, "pending", NOW + timedelta(seconds=20)),
        (3, "failed", None),
        (1, "pending", NOW + timedelta(seconds=10)),
    ]


HREFS = "url string, pos int, raw string, href string"


def hrefs(spark):
    found = ["/x", "/x", "/a.pdf", "/SiteMap.pdf", "/my.document/x", "http://b.com/y", "http://a.com:80/z"]
    rows = [
        ("http://a.com/", i, h, h if "//" in h else "http://a.com" + h) for i, h in enumerate(found)
    ]
    return spark.createDataFrame(rows, HREFS)


def test_discovered_links(spark):
    got = links.discover_links(hrefs(spark), ["a.com", "c.com"]).collect()
    assert sorted(r.href for r in got) == ["http://a.com/SiteMap.pdf", "http://a.com/x"]


def test_allowed_domains_from_a_table(spark):
    domains = spark.createDataFrame([("a.com",), ("a.com",), ("c.com",)], "domain string")
    by_list = links.allowed_links(hrefs(spark), ["a.com", "c.com"])
    by_table = links.allowed_links_by_table(hrefs(spark), domains).select(*by_list.columns)
    assert sorted(by_table.collect()) == sorted(by_list.collect())


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_link_validation_keeps_order(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    rows = [("p", i, f"h{i % 4}", "t", "", "internal", "pending") for i in range(8)]
    found = spark.createDataFrame(
        rows, "url string, pos int, href string, text string, title string, type string, status string"
    )
    checks = spark.createDataFrame(
        [("h0", 200), ("h1", 404), ("h2", None), ("h0", 500)], schemas.LINK_CHECKS
    )
    done = links.collect_links(links.validate_links(found, checks)).first().links
    assert [x.href for x in done] == [f"h{i % 4}" for i in range(8)]
    assert [x.status for x in done][:4] == ["valid", "broken", "broken", "pending"]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 300)
    rows = spark.range(1000).select(F.least(F.lit(4), F.col("id") % 9).alias("k"), "id")
    unique = spark.createDataFrame([(0, "a"), (4, "b")], "k long, v string")
    hot = joins.hot_keys(rows, ["k"])
    assert [r.k for r in hot.collect()] == [4]
    plain = rows.join(unique, "k", how)
    salted = joins.salted_join(rows, unique, ["k"], hot, F.col("id"), how)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("few", [100_000, 10])
def test_robots_with_many_rules_of_one_host(spark, monkeypatch, few):
    monkeypatch.setattr(frontier, "FEW_RULES", few)
    """As many rules as urls on one host: each url meets the rules of its own prefixes only."""
    n = 20_000
    rules = spark.range(n).select(
        F.lit("a.com").alias("host"),
        F.lit("*").alias("agent"),
        F.col("id").cast("int").alias("seq"),
        (F.col("id") % 2 == 0).alias("allow"),
        F.concat(F.lit("/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path_prefix"),
    )
    rows = spark.range(n).select(
        "id", F.concat(F.lit("http://a.com/"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("/x")).alias("url")
    )
    got = frontier.robots_allowed(rows, rules, "loom")
    assert got.where(F.col("robots_ok") != (F.col("id") % 2 == 0)).isEmpty()
    assert got.count() == n


def test_more_links_on_a_page_than_a_thousand_fold_key_holds(spark):
    """Order is (page, place on it): a later page's link stays later, whatever the number of links."""
    seq = "struct<page_id:bigint,pos:int>"
    rows = [("j", f"http://a.com/{k}", "p0", 1, (0, k)) for k in range(5001)]
    rows += [("j", "http://a.com/dup", "p0", 1, (0, 5001)), ("j", "http://a.com/dup", "p5", 1, (5, 0))]
    candidates = spark.createDataFrame(
        rows, f"job_id string, url string, parent_url string, depth int, seq {seq}"
    )
    none = spark.createDataFrame([], "job_id string, normalized_url string")
    outcomes = {
        r.outcome: r["count"]
        for r in frontier.enqueue_outcomes(candidates, none).groupBy("outcome").count().collect()
    }
    assert outcomes == {"queued": 5002, "duplicate": 1}
    entering = frontier.enqueue(candidates, none)
    assert entering.count() == 5002
    assert entering.where("url like '%dup'").first().parent_url == "p0"
