"""Golden pages: one rule each, expected rows written by hand from the rules."""

import random
import time
from datetime import datetime
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import dom, text
from pageloom.operators import extract
from pageloom.operators.parse import NodeCollector, collect_nodes

BASE = "http://a.com/docs/guide/x"
AT = datetime(2024, 1, 1)

PAGES = {
    "no-title": "<p>hello</p>",
    "empty-title": "<title></title>",
    "child-title": "<title><b> in </b></title>",
    "two-titles": "<title> One </title><title>Two</title>",
    "boilerplate": (
        "<script>s</script><style>t</style><nav><a href=/n>nav</a></nav><footer>f</footer>"
        "<aside>g</aside><advertisement>h</advertisement><div class=advertisement>kept</div>"
    ),
    "headings": "<h1 id=top>A <b>b</b> c</h1><h3> d </h3><h7>no</h7><h6 id=''>e</h6>",
    "paragraphs": "<p>1234567890</p><p>12345678901</p><p> 12345 <i>6789</i> 01 </p>",
    "unclosed": "<div><p>first text here<p>second text here</p> tail</div><p>third text here</p>",
    "stray-end": "<div>a</span></p>b</div></div>c",
    "code": (
        '<pre data-filename="m.py"><code class="x language-py-3 lang-z">a = 1\n b</code></pre>'
        '<code class="lang-js">  <b>x</b></code><pre>  </pre>'
    ),
    "images": (
        '<img><img src=""><img src="/r.png" alt="A" title="T"><img src="rel.png" alt="">'
        '<figure><p><img src="f.png"></p><figcaption> Fig <b>1</b></figcaption></figure>'
        '<div><img src="s.png"><b>x</b><p class="big caption">Cap</p></div>'
        '<div><img src="n.png"><span>no</span><p class="caption">late</p></div>'
        '<figure><img src="g.png"><div class="caption">inside</div></figure>'
    ),
    "links": (
        '<a href="y">Y</a><a href="#top" title="t"> Top </a><a href="/e"><img src=i></a>'
        '<a>none</a><a href="http://b.com/z">B</a><a href="http://a.com:80/p">P</a><a href="">self</a>'
    ),
    "table-thead": (
        "<table><caption> C </caption><thead><tr><th>h1</th><td>h2</td></tr></thead>"
        "<tr><td>1</td><td>2</td></tr><tr></tr></table>"
    ),
    "table-th": "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><th>2</th></tr></table>",
    "table-plain": "<table><tr><td>a</td><th>b</th></tr></table>",
    "table-empty": "<table></table><table><tr><th>only</th></tr></table>",
    "table-nested": (
        "<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>"
    ),
    "lists": "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul><ul></ul>",
    "crumb-class": '<div class="x breadcrumb"><a>A</a><span> </span><b><span>B</span></b></div>',
    "crumb-order": '<ol id="breadcrumb"><a>id</a></ol><div class="breadcrumbs"><a>class</a></div>',
    "crumb-aria": '<div aria-label="breadcrumb"><a>aria</a></div>',
    "crumb-navclass": '<div class="nav-breadcrumb"><a>nc</a></div>',
    "crumb-id": '<div id="breadcrumb"><a>id</a></div>',
    "crumb-in-nav": '<nav class="breadcrumb"><a>gone</a></nav>',
    "crumb-empty": '<div class="breadcrumb"></div><div id="breadcrumb"><a>later</a></div>',
    "steps": (
        '<a href="n0">Ne<b>xt</b></a><a href="n1"><i>NEXT</i></a><a href="n2">next</a>'
        '<a href="p">Feedback</a>'
    ),
    "steps-nohref": '<a>continue</a><a href="n">next</a>',
    "seo": (
        '<meta name="description" content="D"><meta name="keywords" content=" a, ,b,">'
        '<meta property="og:title" content="OT"><meta property="og:description" content="OD">'
        '<meta property="og:image" content="OI"><link rel="x canonical" href="/c">'
    ),
    "seo-empty": '<meta name="description"><meta name="keywords">',
    "entities": "<p>&lt;a&gt; &#65;&#x42; &unknown; &eacute;&nbsp;x &#128;</p>",
    "comments": "a<!-- x -->b<!DOCTYPE y>c<![CDATA[d]]>e<template>hid</template><rt>r</rt>",
    "void": "<p>one<br>two<br/>three<hr>four five</p></br>",
    "main": "<main><p>x</p></main>",
    "empty": "",
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (BASE + "?k=" + k, h, 200, "text/html", {"etag": "e"}, 0.5, AT, "job", 1, None)
        for k, h in PAGES.items()
    ]
    return spark.createDataFrame(rows, schemas.RAW_PAGES)


@pytest.fixture(scope="module")
def pages(raw):
    return {r.url.split("?k=")[1]: r for r in extract.extract_pages(raw).collect()}


def parts(pages, key):
    return pages[key].content.structured_data


def test_schema_is_the_declared_one(raw):
    def plain(t):
        return t.simpleString()

    assert plain(extract.extract_pages(raw).schema) == plain(schemas.PAGES)


def test_titles(pages):
    expected = {"no-title": "", "empty-title": "", "child-title": "in", "two-titles": "One"}
    assert {k: pages[k].title for k in expected} == expected


def test_boilerplate_is_dropped(pages):
    assert pages["boilerplate"].content.clean_text == "kept"
    assert parts(pages, "boilerplate").links == []


def test_clean_text_joins_stripped_nodes(pages):
    assert pages["two-titles"].content.clean_text == "One Two"
    assert pages["headings"].content.clean_text == "A b c d no e"
    assert pages["comments"].content.clean_text == "a b c d e"
    assert pages["stray-end"].content.clean_text == "a b c"
    assert pages["empty"].content.clean_text == ""


def test_entities(pages):
    assert parts(pages, "entities").paragraphs == ["<a> AB &unknown é x €"]


def test_headings(pages):
    rows = [tuple(h) for h in parts(pages, "headings").headings]
    assert rows == [("h1", "Abc", "top", "#top"), ("h3", "d", "", ""), ("h6", "e", "", "")]


def test_paragraphs(pages):
    assert parts(pages, "paragraphs").paragraphs == ["12345678901", "12345678901"]
    assert parts(pages, "unclosed").paragraphs == [
        "first text heresecond text heretail",
        "second text here",
        "third text here",
    ]


def test_code_blocks(pages):
    rows = [tuple(c) for c in parts(pages, "code").code_blocks]
    assert rows == [
        ("", "a = 1\n b", "m.py"),
        ("py-3", "a = 1\n b", ""),
        ("js", " x", ""),
        ("", "  ", ""),
    ]


def test_images(pages):
    rows = [tuple(i) for i in parts(pages, "images").images]
    assert rows == [
        ("http://a.com/r.png", "A", "T", "", ""),
        ("rel.png", "", "", "", ""),
        ("f.png", "", "", "Fig1", ""),
        ("s.png", "", "", "Cap", ""),
        ("n.png", "", "", "", ""),
        ("g.png", "", "", "inside", ""),
    ]


def test_captions_of_nested_figures_and_many_images(spark):
    """Work per image does not grow with the images of its page."""
    many = "".join(f'<div><img src="/i{k}.png"><span class="caption">c{k}</span></div>' for k in range(4000))
    shared = "<figure>" + '<img src="/f.png">' * 1000 + "<figcaption>all</figcaption></figure>"
    nested = (
        '<figure><img src="/out.png"><figure><img src="/in.png"><figcaption>inner</figcaption></figure>'
        '<figcaption>outer</figcaption></figure><figure><figure><img src="/bare.png"></figure>'
        '<figcaption>later</figcaption></figure><img src="/x.png"><img src="/y.png"><p class="caption">two</p>'
        '<img src="/z.png"><nav><p class="caption">gone</p></nav><p>none</p><p class="caption">late</p>'
    )
    rows = [("http://a.com/p", many + shared + nested)]
    raw = spark.createDataFrame(rows, "url string, html string")
    found = [(r.src.rsplit("/")[-1], r.caption) for r in extract.images(raw).orderBy("pos").collect()]
    assert found[:4000] == [(f"i{k}.png", f"c{k}") for k in range(4000)]
    assert found[4000:5000] == [("f.png", "all")] * 1000
    # The first caption inside a figure is its own, also when an inner figure holds it.
    assert found[5000:] == [
        ("out.png", "inner"),
        ("in.png", "inner"),
        ("bare.png", ""),
        ("x.png", "two"),
        ("y.png", "two"),
        ("z.png", ""),
    ]


def test_links(pages):
    page = BASE + "?k=links"
    rows = [tuple(x) for x in parts(pages, "links").links]
    assert rows == [
        ("http://a.com/docs/guide/y", "Y", "", "internal", "pending"),
        (page + "#top", "Top", "t", "internal", "pending"),
        ("http://b.com/z", "B", "", "external", "pending"),
        ("http://a.com:80/p", "P", "", "external", "pending"),
        (page, "self", "", "internal", "pending"),
    ]


def table_rows(pages, key):
    return [(t.headers, t.rows, t.caption) for t in parts(pages, key).tables]


def test_tables(pages):
    assert table_rows(pages, "table-thead") == [
        (["h1", "h2"], [["h1", "h2"], ["1", "2"]], "C")
    ]
    assert table_rows(pages, "table-th") == [(["a", "b"], [["1", "2"]], "")]
    assert table_rows(pages, "table-plain") == [([], [["a", "b"]], "")]
    assert table_rows(pages, "table-empty") == []
    assert table_rows(pages, "table-nested") == [
        ([], [["oi", "i"], ["i"]], ""),
        ([], [["i"]], ""),
    ]


def test_lists(pages):
    rows = [(x.type, x["items"]) for x in parts(pages, "lists").lists]
    assert rows == [("unordered", ["ab", "b", "c"]), ("ordered", ["b"])]


def test_breadcrumbs(pages):
    expected = {
        "crumb-class": ["A", "B"],
        "crumb-order": ["class"],
        "crumb-aria": ["aria"],
        "crumb-navclass": ["nc"],
        "crumb-id": ["id"],
        "crumb-in-nav": [],
        "crumb-empty": [],
        "empty": [],
    }
    assert {k: pages[k].navigation.breadcrumb for k in expected} == expected


def test_next_and_previous(pages):
    nav = pages["steps"].navigation
    assert (nav.next_page, nav.prev_page) == (
        "http://a.com/docs/guide/n1",
        "http://a.com/docs/guide/p",
    )
    assert pages["steps-nohref"].navigation.next_page == ""
    assert (nav.section, nav.subsection, nav.page_type) == ("docs", "guide", "documentation")


def test_seo(pages):
    assert tuple(pages["seo"].seo) == ("D", ["a", "", "b", ""], "OT", "OD", "OI", "/c")
    assert tuple(pages["seo-empty"].seo) == ("", [""], "", "", "", "")
    assert tuple(pages["empty"].seo) == ("", [], "", "", "", "")


def test_void_elements_take_no_children(pages):
    assert pages["void"].content.clean_text == "one two three four five"
    assert parts(pages, "void").paragraphs == ["onetwothreefour five"]


def test_accessibility(pages):
    images = pages["images"].accessibility
    assert (images.has_alt_text, images.has_headings) == (False, False)
    assert pages["headings"].accessibility.has_headings
    assert pages["empty"].accessibility.has_alt_text
    assert pages["empty"].accessibility.readability_score == 0
    assert pages["unclosed"].accessibility.readability_score == pytest.approx(100 - 2 * 8)


def test_discovered_hrefs_keep_boilerplate(raw):
    rows = extract.discovered_hrefs(raw).where(F.col("url").endswith("boilerplate")).collect()
    assert [(r.raw, r.href) for r in rows] == [("/n", "http://a.com/n")]


def words_page(n):
    return "<p>" + " ".join(["word"] * n) + "</p>"


def test_quality_score(spark):
    cases = {
        "": 0,
        "<title></title>": 5,
        "<main></main>": 5,
        '<div role="main"></div><nav></nav>': 0,
        "<h2>x</h2>": 20,
        "<p>long enough</p>" * 2: 0,
        "<p>long enough</p>" * 3: 15,
        '<img src="x">': 10,
        '<img src="x" alt="y">': 12,
        '<img src="x" alt="y">' * 6: 20,
        '<a href="x">y</a>': 10,
        words_page(99): 0,
        words_page(100): 10,
        words_page(299): 10,
        words_page(300): 15,
        '<meta name="description">': 5,
        "<title>t</title><meta name=description><h1>x</h1><main>"
        + words_page(300) * 3
        + '<img src="x" alt="y">' * 5
        + "<a href=x>y</a></main><nav>n</nav>": 95,
    }
    rows = [
        (f"http://a.com/{i}", h, 200, "text/html", {}, 0.5, AT, "job", 1, None)
        for i, h in enumerate(cases)
    ]
    scored = extract.extract_pages(spark.createDataFrame(rows, schemas.RAW_PAGES))
    got = {int(r.url.rsplit("/", 1)[1]): r.quality_score for r in scored.collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_routing_happens_before_parsing(spark):
    def row(name, status, kind):
        return (f"http://a.com/{name}", "<p>x</p>", status, kind, {}, 0.1, AT, "j", 0, None)

    raw = spark.createDataFrame(
        [
            row("ok", 200, "Text/HTML; charset=x"),
            row("redirect", 399, "text/html"),
            row("gone", 400, "text/html"),
            row("error", 503, "application/pdf"),
            row("pdf", 200, "application/pdf"),
            row("none", 200, None),
        ],
        schemas.RAW_PAGES,
    )
    got = {r.url.rsplit("/", 1)[1]: r.outcome for r in extract.route_responses(raw).collect()}
    assert got == {
        "ok": "page",
        "redirect": "page",
        "gone": "error",
        "error": "error",
        "pdf": "skipped",
        "none": "skipped",
    }
    plan = extract.extract_pages(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.index("MapInArrow") < plan.rindex("Filter")


def test_metadata(pages):
    meta = pages["main"].metadata
    assert (meta.etag, meta.scraping_job_id, meta.page_depth) == ("e", "job", 1)
    assert (meta.content_length, meta.language, meta.charset) == (len(PAGES["main"]), "en", "utf-8")
    assert meta.last_modified is None and meta.last_modified_at is None


def test_bad_pages_do_not_end_the_job(raw, monkeypatch):
    good, error = collect_nodes("http://a.com", "<p>x")
    assert error is None and [n[2] for n in good.nodes] == ["p", "#text"]

    def reject(self, data):
        raise AssertionError("unknown declaration")

    monkeypatch.setattr(NodeCollector, "feed", reject)
    bad, error = collect_nodes("http://a.com", "<p>x")
    assert bad.nodes == [] and error == "AssertionError: unknown declaration"


def test_rejected_pages_become_errors(raw):
    assert extract.parse_failures(raw).columns == ["job_id", "url", "error_message", "fetched_at"]
    assert extract.parse_failures(raw).isEmpty()


def test_invalid_href_is_kept_as_written(spark):
    row = ("http://a.com/x", '<a href="http://[bad">t</a>', 200, "text/html", {}, 0.1, AT, "j", 0, None)
    raw = spark.createDataFrame([row], schemas.RAW_PAGES)
    assert [r.href for r in extract.links(raw).collect()] == ["http://[bad"]


def unclosed(n):
    return "".join(f"<p>paragraph {k:05d} " for k in range(n))


def test_white_space_of_the_tokenizer_is_that_of_the_texts():
    from pageloom.functions import text
    from pageloom.operators import parse

    assert set(parse.WHITESPACE) == set(text.WHITESPACE)


@pytest.mark.parametrize("run", [1, 60, 1_000_000])
def test_unclosed_paragraphs_come_run_by_run(spark, monkeypatch, run):
    monkeypatch.setattr(dom, "RUN_CHARS", run)
    pages = spark.createDataFrame(
        [("http://a.com/1", unclosed(12)), ("http://a.com/2", "<p>short</p><p>long enough <b>now</b></p>"), ("http://a.com/3", "x"), ("http://a.com/4", None)],
        "url string, html string",
    )
    got = {(r.url[-1], r.pos): r.text for r in extract.paragraphs(pages).collect()}
    whole = extract.page_parts(pages, item=dom.paragraphs()).collect()
    assert got == {(r.url[-1], k): t for r in whole for k, t in enumerate(r.item)}
    assert got["2", 0] == "long enoughnow" and len(got) == 13


def test_very_many_unclosed_paragraphs(spark):
    """Texts that add up to hundreds of megabytes come as rows; as one document the page is an error row."""
    n = 6000
    row = ("http://a.com/1", unclosed(n), 200, "text/html", {}, 0.1, datetime(2024, 1, 1), "j", 0, None)
    raw = spark.createDataFrame([row], schemas.RAW_PAGES)
    rows = extract.paragraphs(raw.select("url", "html")).agg(F.count("*"), F.sum(F.length("text")), F.max("pos")).first()
    assert tuple(rows) == (n, 15 * n * (n + 1) // 2, n - 1)
    assert extract.extract_pages(raw).collect() == []
    failed = extract.parse_failures(raw).collect()
    assert [r.url for r in failed] == ["http://a.com/1"] and "add up to" in failed[0].error_message


def test_a_page_of_many_elements_costs_linear_time(spark):
    page = "".join(f"<p>paragraph number {k}</p><h2>h{k}</h2>" for k in range(40_000))
    began = time.time()
    found = extract.page_parts(frame_of(spark, page), p=dom.paragraphs(), h=dom.headings())
    row = found.select(F.size("p"), F.size("h"), F.col("h")[39_999]["text"]).first()
    assert tuple(row) == (40_000, 40_000, "h39999")
    assert time.time() - began < 20


def frame_of(spark, page):
    return spark.createDataFrame([(BASE, page)], "url string, html string")


class Plainly(NodeCollector):
    """The collector with the tokenizer alone."""

    goahead = HTMLParser.goahead


MARKUP = (
    "< & > \" ' </p> <!-- --> <?x <!x <![CDATA[ ]]> &amp &amp; &#x41; &#12a; &#; <script> </script\t> </\tstyle> <style> "
    "<a\thref=x> <a\thref='a&amp;b'> <IMG\tSRC=\"/é\"\tALT=\"a<b>c\"> <br/> <p\n> </P> <td/\t> &nosuch; <é> \x00 = / "
    "<b\ta=\"1\"b=\"2\"> <b\ta=\"1\"\ta=\"2\"> </b\tx> <!DOCTYPE\thtml> <p\tx=\" <figure> <figcaption> <div\tclass=\"caption\"> x"
).split(" ")


def test_plain_tokens_are_read_as_the_tokenizer_reads_them():
    rng = random.Random(3)
    samples = ["".join(rng.choice(MARKUP) for _ in range(rng.randrange(14))).replace("\t", " ") for _ in range(3000)]
    for page in [*PAGES.values(), *samples]:
        collector, error = collect_nodes(BASE, page)
        plain = Plainly(BASE)
        try:
            plain.feed(page)
            plain.finish()
        except (AssertionError, ValueError):
            assert error
            continue
        for found, expected in zip(collector.nodes, plain.nodes, strict=True):
            assert tuple(map(str, found)) == tuple(map(str, expected)) or list(found[3]) == list(expected[3]), page
        assert (collector.last, collector.hrefs, collector.chars) == (plain.last, plain.hrefs, plain.chars), page


def test_plain_tags_do_without_the_tokenizer(monkeypatch):
    def refuse(*_):
        raise ValueError("not needed")

    monkeypatch.setattr(HTMLParser, "parse_starttag", refuse)
    collector, error = collect_nodes(BASE, '<div class="a b"><P id="x">one &amp; two</P><style>p {}</style></div>')
    assert error is None and collector.chars[0] == len("one & two")


def test_parts_go_over_the_nodes_few_times(spark):
    """Nodes are looked through once for a breadcrumb, words of a text counted once for its readability."""
    html = '<p class="x breadcrumbs-like">a</p><div class="a breadcrumbs"><a>One</a> <span> </span><span>Two</span></div>'
    raw = spark.createDataFrame([("http://a.com/1", html)], "url string, html string")
    parts = extract.page_parts(raw, crumbs=dom.breadcrumb(), clean=dom.clean_text())
    found = parts.first()
    assert (found.crumbs, found.clean) == (["One", "Two"], "a One Two")
    plan = parts._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(nodes#") <= 1, plan
    scored = spark.createDataFrame([("one two. three",), ("",), (None,)], "t string").select(text.readability(F.col("t")).alias("r"))
    assert scored._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [r.r for r in scored.collect()] == [97.0, 0.0, 0.0]


def test_plain_elements_take_few_calls():
    """Elements of nothing but text are read without a call for each of their tags (F13-F24)."""
    page = "".join(f'<tr><td id="c{k}">{k}</td><td> </td><th></th></tr><p>line <b>{k}</b>\xa0</p>\n' for k in range(50))
    calls = []

    class Counted(NodeCollector):
        def handle_starttag(self, tag, attrs):
            calls.append(tag)
            super().handle_starttag(tag, attrs)

        def handle_endtag(self, tag):
            calls.append(tag)
            super().handle_endtag(tag)

    found, plain = Counted(BASE), Plainly(BASE)
    for collector in (found, plain):
        collector.feed(page)
        collector.finish()
    assert calls == []
    assert [tuple(map(str, n[:3] + n[4:])) for n in found.nodes] == [tuple(map(str, n[:3] + n[4:])) for n in plain.nodes]
    assert [list(n[3]) for n in found.nodes] == [list(n[3]) for n in plain.nodes]
    assert (found.last, found.chars) == (plain.last, plain.chars)


def test_only_the_columns_a_part_reads_leave_the_parser(spark):
    raw = frame_of(spark, '<a href="/x/y.html">\u2003one </a><a href="../z">two</a>')
    plan = extract.discovered_hrefs(raw)._jdf.queryExecution().analyzed().toString()
    assert "nodes#" not in plan and "element_chars#" not in plan
    assert [r.href for r in extract.discovered_hrefs(raw).collect()][0].endswith("/x/y.html")
    found = extract.links(raw)
    assert "hrefs#" not in found._jdf.queryExecution().analyzed().toString()
    assert [r.text for r in found.collect()] == ["one", "two"]
