"""URL expressions against plain Python over the edge list."""

from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import urls

EDGES = [
    "http://a.com",
    "http://a.com/",
    "HTTP://A.com/Path/",
    "http://a.com//",
    "http://a.com/x/y/",
    "http://a.com/x//",
    "http://a.com/x?b=2&a=1&&a=1",
    "http://a.com/x?",
    "http://a.com/x?r=/",
    "http://a.com/p;v=1",
    "http://a.com/p;v=1/q",
    "http://a.com/p/q;v=1;w=2?z=1",
    "http://a.com/x#frag",
    "http://a.com/x#f?rag",
    "http://a.com:8080/x",
    "http://user:pw@a.com/x",
    "mailto:me@a.com;x",
    "relative/path",
    "//a.com/no-scheme",
    "http://a.com/straße/é",
    "  http://a.com/padded \n",
    "http://a.com/Docs.DOCX",
    "http://a.com/my.document/x",
    "http://a.com/a.pdf/b",
    "http://a.com/sitemap.pdf",
    "http://a.com/?q",
    "javascript:void(0)",
    "",
]


def expected_normal(url):
    p = urlparse(url.lower().strip())
    out = f"{p.scheme}://{p.netloc}{p.path}"
    if p.query:
        out += "?" + "&".join(sorted(p.query.split("&")))
    return out.rstrip("/") if out.endswith("/") and out.count("/") > 3 else out


def expected_parts(url):
    return [x for x in urlparse(url).path.split("/") if x]


@pytest.fixture(scope="module")
def computed(spark):
    u = F.col("url")
    rows = (
        spark.createDataFrame([(x,) for x in EDGES], "url string")
        .select(
            "url",
            urls.normalize_url(u).alias("normal"),
            urls.netloc(u).alias("netloc"),
            urls.path(u).alias("path"),
            urls.section(u).alias("section"),
            urls.subsection(u).alias("subsection"),
            urls.has_blocked_file_type(u).alias("blocked"),
        )
        .collect()
    )
    return {r.url: r for r in rows}


@pytest.mark.parametrize("url", EDGES)
def test_matches_plain_python(computed, url):
    row = computed[url]
    assert row.normal == expected_normal(url)
    if url == url.strip():
        parts = [*expected_parts(url), "", ""]
        assert row.netloc == urlparse(url).netloc
        assert row.path == urlparse(url).path
        assert (row.section, row.subsection) == (parts[0], parts[1])
        types = (".pdf", ".jpg", ".png", ".gif", ".zip", ".doc")
        assert row.blocked == any(t in urlparse(url).path.lower() for t in types)


def test_page_type(spark):
    cases = {
        "http://a.com": "home",
        "http://a.com/?q=1": "home",
        "http://a.com/x/blog/y": "blog",
        "http://a.com/about/docs": "documentation",
        "http://a.com/documentation": "documentation",
        "http://a.com/contact/about": "about",
        "http://a.com/contact": "contact",
        "http://a.com/Blog": "article",
        "http://a.com/blogs": "article",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select(
        "url", urls.page_type(F.col("url")).alias("kind")
    )
    assert {r.url: r.kind for r in rows.collect()} == cases


def test_link_type(spark):
    page = "http://a.com:80/x"
    cases = {
        "http://a.com:80/y": "internal",
        "http://a.com:80/x#top": "internal",
        "http://a.com/y": "external",
        "http://A.com:80/y": "external",
        "mailto:x@a.com": "external",
        "#top": "anchor",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "href string").select(
        "href", urls.link_type(F.col("href"), F.lit(page)).alias("kind")
    )
    assert {r.href: r.kind for r in rows.collect()} == cases


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abAB/?&=;#.é %", max_size=30), min_size=40, max_size=60))
def test_random_urls(spark, tails):
    given_urls = ["http://H.example" + t for t in tails]
    rows = (
        spark.createDataFrame([(u,) for u in given_urls], "url string")
        .select("url", urls.normalize_url(F.col("url")).alias("normal"))
        .collect()
    )
    for row in rows:
        assert row.normal == expected_normal(row.url)


def test_http_url_check(spark):
    good = ["http://a.com", "https://a.com/x?y"]
    bad = ["ftp://a.com", "a.com", "http://", "http:///x", "http://a b.com", None, "http://" + "a" * 2100]
    rows = spark.createDataFrame([(u,) for u in good + bad], "url string").select(
        "url", urls.is_http_url(F.col("url")).alias("ok")
    )
    assert {r.url for r in rows.collect() if r.ok} == set(good)


def plainly_normalized(url):
    """The rule by the standard library's own splitting, not by a pattern."""
    parts = urlparse(url.lower().strip())
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    joined = f"{parts.scheme}://{parts.netloc}{parts.path}" + (f"?{query}" if query else "")
    return joined.rstrip("/") if joined.endswith("/") and joined.count("/") > 3 else joined


def test_every_given_url_is_normalized_as_by_the_library(spark):
    sf = "/root/testdata/sf0.01"
    from pageloom.plans import inputs

    given = inputs.pages_table(spark, sf).select("url").union(inputs.url_queue(spark, sf).select("url")).distinct()
    odd = [("HTTP://A.com/x;p=1/y;q?b=2&a=1&&c#f",), (" https://a.com ",), ("https://a.com/a/?",), ("http://a.com//",), ("http://u:p@a.com:80/é/?x=/",)]
    rows = given.union(spark.createDataFrame(odd, "url string"))
    got = rows.select("url", urls.normalize_url(F.col("url")).alias("n")).collect()
    assert len(got) > 100
    assert {r.url: r.n for r in got} == {r.url: plainly_normalized(r.url) for r in got}
