"""The training-data operators against brute force, and on odd rows."""

import base64
import hashlib
import html
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import bpe, embeddings, fertility, htmltext, jaccard, kneser, linededup, mixing, toxicity, warc
from pageloom.llm.oracles import ORACLES
from pageloom.llm.queries import QUERIES
from pageloom.llm.storage import Scratch, settings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string"
LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [
    (1, None, "en", "a", 0, 1, "x"),
    (2, "", "en", "a", 0, 1, "x"),
    (3, " \n\t ", None, None, 4, 1, None),
    (4, "same words here again", "en", "a", 21, 2, "y"),
    (5, "same words here again", "en", "a", 21, 2, "y"),
    (5, "same words here again", "en", "a", 21, 2, "y"),
    (6, LONG, "en", None, len(LONG), 3, "z"),
    (7, LONG + " one more", "de", "b", 0, 3, "z"),
    (None, "no number at all, long enough line\nno number at all, long enough line", None, "b", 0, 0, ""),
    (8, "é 漢字 🙂 'tis we'll\r\n\n  x", "fr", "b", 0, 0, ""),
]


def rows(query, columns):
    return sorted(tuple(r[c] for c in columns) for r in query.collect())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def jaccard_groups(documents, size, percent):
    sets = {}
    for doc_id, text, *_ in documents:
        words = WORD.findall(fold(text))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets[doc_id] = grams
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, documents, size, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = jaccard.jaccard_join(docs, Scratch(spark, "t"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(documents, size, percent)


def test_jaccard_join_of_chains_and_random_edits(spark):
    """Near copies of near copies: what is linked only through others is one component."""
    rng = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    made = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
        made.append((k, " ".join(words), ""))
        if k % 10 == 0:
            base = [f"b{k}-{j}" if rng.random() < 0.5 else w for j, w in enumerate(base)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = jaccard.jaccard_join(docs, Scratch(spark, "t"), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(made, 3, 80)


def test_line_dedup_against_sql(spark, duck):
    result = duck.execute(ORACLES["op5_line_dedup"])
    names = [d[0] for d in result.description]
    assert rows(QUERIES["op5_line_dedup"](spark, SF), names) == sorted(result.fetchall())


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup_in_any_number_of_batches(spark, batches):
    text = {1: "alpha beta gamma\nshort", 4: "Alpha Beta Gamma \nÉtude de lignes", 9: "étude de lignes\n  ALPHA beta gamma", 2: None}
    docs = spark.createDataFrame([(k, v) for k, v in text.items()], "doc_id long, text string")
    out = linededup.dedup_lines(docs, Scratch(spark, "t"), batches=batches).collect()
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out}
    assert got == {
        1: (text[1], 2, 0),
        2: (None, 1, 0),
        4: ("Étude de lignes", 2, 1),
        9: ("étude de lignes", 2, 1),
    }


@pytest.mark.parametrize("seed", [1, 7])
def test_long_and_short_documents_are_taken_alike(seed):
    """At half the budget every tenth of the lengths gives about half of its words, and another seed others."""
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.maximum(1, rng.lognormal(6, 1, 3000).astype(np.int64)), return_counts=True)
    whole = int((lengths * counts).sum())
    chosen = mixing.fit(lengths, counts, whole // 2, seed)
    assert int((lengths * chosen).sum()) == whole // 2 and (chosen <= counts).all() and (chosen >= 0).all()
    tenth = np.minimum(9, np.cumsum(counts) * 10 // counts.sum())
    for k in range(10):
        share = (lengths * chosen)[tenth == k].sum() / (lengths * counts)[tenth == k].sum()
        assert 0.38 < share < 0.62, (k, share)
    assert not np.array_equal(chosen, mixing.fit(lengths, counts, whole // 2, seed + 1))


def test_mix_meets_its_targets(spark, documents):
    got = QUERIES["op7_source_mix"](spark, SF).collect()
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:  # reshare until no source is above its cap
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    target.update({s: weight[s] * level for s in free})
    source_of = {d: s for d, _, s in documents}
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        taken[s] += r.taken
        assert math.isclose(r.target, target[s], rel_tol=1e-9) and r.taken in [k * r.size for k in range(4)]
    # Sources of a few documents here cannot reach every sum.
    assert all(abs(taken[s] - target[s]) <= max(1, 0.02 * target[s]) for s in order)
    again = QUERIES["op7_source_mix"](spark, SF)
    assert rows(again, ["doc_id", "taken"]) == sorted((r.doc_id, r.taken) for r in got)


def test_fit_reaches_sums_that_exist():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = np.sort(rng.choice(np.arange(0, 60), 6, replace=False))
        counts = rng.integers(1, 4, 6)
        budget = int(rng.integers(0, (lengths * counts).sum() + 3))
        chosen = mixing.fit(lengths, counts, budget)
        assert (chosen >= 0).all() and (chosen <= counts).all()
        sums = {0}
        for length, count in zip(lengths, counts):
            sums = {s + k * int(length) for s in sums for k in range(count + 1)}
        best = min(abs(s - budget) for s in sums)
        assert abs(int((lengths * chosen).sum()) - budget) <= best + lengths.max()


def test_bpe_equals_the_library(spark, documents):
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    signs = "ab st'' rveldm  \n\t 　1²é漢🙂.,!-‍́\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["<|endoftext|>", "x" * 700, "it's we'll 'd ''s", None, " ", *(t for _, t, _ in documents[:40])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(docs, VOCABULARY)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert all(got[k] == library.encode_ordinary(t or "") for k, t in enumerate(texts))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, VOCABULARY).collect()}
    assert all(back[k] == (t or "").encode() for k, t in enumerate(texts))
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        raw = np.array(got[r.doc_id], "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_embeddings_against_all_pairs(spark, duck):
    table = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    unit = np.array([e for _, e in table], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    got = {r.vec_id: r.n_links for r in QUERIES["op9_embedding_duplicates"](spark, SF).collect()}
    truth = {v: int(near[k].sum()) - 1 for k, (v, _) in enumerate(table)}
    assert all(got[v] <= truth[v] for v in truth)
    assert sum(got.values()) >= 0.98 * sum(truth.values())


def test_embeddings_with_thousands_of_links(spark):
    """Groups of near copies of many sizes and pairs just over and under the threshold, against all pairs."""
    rng = np.random.default_rng(9)
    made = []
    for size in [1] * 300 + [2] * 120 + [5] * 60 + [40] * 6 + [110]:
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        for _ in range(size):
            noise = rng.normal(size=64)
            noise -= base * (noise @ base)
            noise /= np.linalg.norm(noise)
            angle = rng.uniform(0, 0.32)
            made.append((np.cos(angle) * base + np.sin(angle) * noise) * rng.uniform(0.1, 10))
    ids = rng.permutation(len(made))
    frame = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(ids, made, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, Scratch(spark, "t")).collect()}
    unit = np.array(made)[np.argsort(ids)]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    truth = near.sum(axis=1)
    found = np.array([got[k].n_links for k in range(len(unit))])
    assert truth.sum() > 6000 and (found <= truth).all() and found.sum() >= 0.99 * truth.sum()
    root = list(range(len(unit)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(near), strict=True):
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    component = [find(k) for k in range(len(unit))]
    same = sum(got[k].component_id == component[k] for k in range(len(unit)))
    assert same >= 0.99 * len(unit)
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(unit)))


def test_embeddings_of_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    given = [(1, v), (2, v), (2, v), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, float("nan"), 0.0]), (6, [1.0, None, 0.0])]
    given += [(7, [2.0, 4.0, 6.0]), (8, [-1.0, -2.0, -3.0]), (9, [1.0, 2.0]), (None, v)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash"))
    got = rows(embeddings.near_duplicates(frame, Scratch(spark, "t")).where("vec_id is not null"), ["vec_id", "n_links", "component_id", "kept"])
    same = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (7, 3, 1, False)]
    assert got == sorted(same + [(k, 0, k, True) for k in (3, 4, 5, 6, 8, 9)])


def test_warc_round_trip(spark):
    html = "<p>a</p>\r\n\r\n<p>é WARC/1.1\r\n\r\n</p>"
    given = [(1, "http://a/1", html), (2, "http://a/2", html), (3, None, None), (4, "http://a/\r\nx: y", ""), (5, "http://a/5", "x" * 300_000), (None, "u", "z")]
    frame = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    found = warc.captures(frame, Scratch(spark, "t"))
    got = {r.metadata.fields.get("page-id"): r for r in found.collect()}
    assert len(got) == 6
    for page, _, text in given:
        r = got[None if page is None else str(page)]
        sha = base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()
        assert r.capture.payload_digest == sha and r.request.id is not None
        if r.capture.kind == "response":
            assert bytes(r.capture.payload) == (text or "").encode() and r.capture.computed_digest == sha
    kinds = {k: (r.capture.kind, r.capture.refers_to) for k, r in got.items()}
    assert kinds["1"] == ("revisit", "page:2") and kinds["3"] == ("revisit", "page:4")
    assert all(kinds[k] == ("response", None) for k in ("2", "4", "5"))
    few = warc.assemble(warc.read_records(spark, _archives(spark, frame, least=10)))
    assert {r.capture.kind for r in few.where("capture.n_bytes = 0").collect()} == {"response", "revisit"}


def _archives(spark, frame, least):
    path = Scratch(spark, "t").path("archives")
    warc.write_archives(frame, path, least)
    return path


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=1>menu</a></nav>
<header><p>site head</p></header><div class="ad">buy this now</div><aside class="sidebar">side</aside>
<div class="content-{n}"><h1>A &amp; B</h1><p>First   para&nbsp;graph with words enough to count {n}.
<p><b>Second</b> one is longer, and it holds <a href=2>a link</a> too.<br>end</p><script>var x="</p>"</script>
<ul><li>one<li>two</ul></div><div id="comments"><p>reader says a lot of words here, many more words than
the article itself has, so that it would win by size alone if it were not left out at all</p></div>
<form><p>form text</p></form><footer>foot</footer></body></html>"""


def test_html_text(spark):
    pages = [(k, f"http://h{k % 2}.com/{k}", PAGE.format(n=k)) for k in range(6)]
    pages += [(10, "http://h0.com/x", None), (11, None, ""), (12, "http://h0.com/y", "<p>lone text, no container")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(frame, Scratch(spark, "t")).collect()}
    for k in range(6):
        text = f"A & B\nFirst para graph with words enough to count {k}.\nSecond one is longer, and it holds a link too. end\none\ntwo"
        assert got[k] == (text, len(text))
    assert got[10] == got[11] == ("", 0)
    assert got[12] == ("lone text, no container", 23)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("plain words only", "plain words only"),
        ("<html><p>x y z</p></html>", "x y z"),
        ("<table><tr><th>head</th><td>cell</td></tr></table>", "head\ncell"),
        ("<ul><li>one<li>two</ul><blockquote>three</blockquote>", "one\ntwo\nthree"),
        (
            "<body><div class='ad'>buy</div><article><h1>T</h1><p class='notice-period'>a long notice period</p>"
            "<p class='social'>social text</p><div class='related-work'>related work is part of it</div>"
            "<div class='comments'>first!</div></article><footer>f</footer></body>",
            "T\na long notice period\nsocial text\nrelated work is part of it",
        ),
        ("<div>" * 20_000 + "deep text" + "</div>" * 20_000, "deep text"),
        ("</p>" * 3 + "<div>" * 3000 + "<p>a</p>" * 3000, "\n".join("a" * 3000)),
        ("<p>" + "w " * 300_000, "w " * 299_999 + "w"),
    ],
)
def test_html_text_of_odd_pages(source, text):
    page = htmltext.Page(source)
    assert page.text(page.best()[0]) == text


def test_html_text_equals_the_article_of_given_pages(spark):
    """Every given page holds one article; its blocks are told apart here by the pages' own plain markup."""
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in QUERIES["op3_html_text"](spark, SF).collect()}
    for page_id, source in rows:
        article = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
        article = re.sub(r"<(script|style|form|aside|nav|footer|header)\b.*?</\1>|<!--.*?-->", "", article, flags=re.S)
        found = re.split(r"</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote|table|tr|td|th|pre)\b[^>]*>", article)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group().startswith("<br") else "", x)).split()) for x in found]
        assert got[page_id] == "\n".join(t for t in texts if t)


def test_fertility_counts_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op6_token_fertility"](spark, SF).collect()}
    for doc_id, text, _ in documents:
        text = text or ""
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        r = got[doc_id]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_toxicity_on_held_out_labels(spark):
    frame = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = [(r.predicted, r.toxic) for r in frame.join(labels, "doc_id").collect()]
    hits = sum(p == t == 1 for p, t in seen)
    assert hits >= 0.85 * sum(t for _, t in seen) and hits >= 0.9 * sum(p for p, _ in seen)


def test_grammar_does_not_depend_on_the_order_of_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = toxicity.learn(docs, labels, Scratch(spark, "t"))
    two = toxicity.learn(docs.repartition(13, "text"), labels.repartition(5, "quality"), Scratch(spark, "t"))
    assert (one.stems, one.weights, one.bias) == (two.stems, two.weights, two.bias)


def test_grammar_scores_clauses():
    match = toxicity.Matcher(toxicity.Grammar({"idiot": 3.0}))
    at, plain = match.score("You are an idiot, you idiot."), match.score("an idiot")
    negated, said = match.score("He is not an idiot."), match.score('She said he was an idiot.')
    assert at > plain > max(negated, said)
    assert match.score(None) == match.score("") == match.score("nothing here")
    assert match.score("I will kill you") > match.score("I will kill time")


def test_kneser_ney_sums_to_one(spark):
    """Over all next characters of a seen context the probabilities add up to one."""
    words = spark.createDataFrame([("abab", 3), ("abc", 2), ("b", 5), ("cab", 1)], "word string, n long")
    model = kneser.train(words, Scratch(spark, "t"))
    ends = ["a", "b", "c", kneser.END, "?"]
    pad = kneser.BEGIN
    for context in (pad * 4, pad * 3 + "a", pad + "aba", "zzzz"):
        grams = spark.createDataFrame([(context + e,) for e in ends], "gram string")
        total = sum(math.exp(r.lp) for r in kneser.log_probabilities(grams, model).collect())
        assert math.isclose(total, 1.0, rel_tol=1e-6)


def test_kneser_ney_keeps_trusted_text(spark, duck):
    got = {r.doc_id: r.kept for r in QUERIES["op2_kneser_ney"](spark, SF).collect()}
    good = [d for (d,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()]
    assert sum(got[d] for d in good) >= 0.9 * len(good)


def test_kneser_ney_moves_no_texts(spark, monkeypatch):
    """No exchange of any step carries texts, packed or not, or rows of n-grams by shard; all rows get their score."""
    plans, save = [], Scratch.save

    def noted(self, df, *args, **kwargs):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return save(self, df, *args, **kwargs)

    monkeypatch.setattr(Scratch, "save", noted)
    texts = ["one two three two", "two three", "é 漢字 one", "", None, "\x02 \x03x one"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (5, 1)], "doc_id long, quality int")
    many = str(kneser.BUCKETS + 12)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": many}):
        got = {r.doc_id: r.perplexity for r in kneser.classify(docs, labels, Scratch(spark, "t")).collect()}
    assert sorted(k for k, p in got.items() if p is not None) == [0, 1, 2, 5] and len(got) == 6
    moved = [
        set(re.findall(r"(\w+)#", node.split("Input", 1)[1].split("\n")[0]))
        for plan in plans
        for node in re.split(r"\n(?=\(\d+\) )", plan)
        if re.match(r"\(\d+\) Exchange", node)
    ]
    assert moved and not any(m & {"text", "packed"} or {"shard", "gram"} <= m for m in moved)


def test_kneser_ney_blocks_hold_each_gram_once():
    grams = np.array([[ord(c) for c in g] for g in ("\x02\x02\x02\x02a", "abcde", "漢字🙂é\x03", "abcdf")], np.uint32)
    blocks = kneser.gram_blocks(grams, kneser.gram_keys(grams), 3)
    assert kneser.gram_blocks(grams[:0], np.empty(0, np.uint64), 3) == []
    assert sorted(b["part"] for b in blocks) == sorted({int(k % 3) for k in kneser.gram_keys(grams)})
    back = [g for b in blocks for g in kneser.gram_strings(kneser.block_grams(b["grams"]))]
    assert sorted(back) == sorted(kneser.gram_strings(grams))


def test_odd_documents(spark, odd):
    ids = [r[0] for r in ODD]
    scratch = Scratch(spark, "t")
    found = jaccard.jaccard_join(odd, scratch).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == sorted(
        [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 8)]
    )
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    outputs = [
        linededup.dedup_lines(odd, scratch),
        mixing.mix_sources(odd, scratch),
        bpe.encode(odd, VOCABULARY),
        fertility.judge(odd, scratch, public_tokenizers.path("piece_bpe_32k.model")),
        toxicity.score_documents(odd, toxicity.learn(odd, labels, scratch)),
        kneser.classify(odd, labels, Scratch(spark, "t2")),
    ]
    for frame in outputs:
        assert sorted(r.doc_id or 0 for r in frame.collect()) == sorted(i or 0 for i in ids)
    assert {"n", "key", "lang"} <= set(outputs[0].columns) and {"n", "key"} <= set(outputs[2].columns)


def test_odd_documents_have_the_right_values(spark, odd):
    """Not only the ids: tokens, kept lines, sizes and base counts of every odd row, worked out plainly here."""

    def order(found):
        return sorted(found, key=repr)

    ranks = bpe.read_ranks(VOCABULARY)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc_id, text, *_ in ODD:
        ids = plain.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        expected.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), sha))
    got = bpe.round_trip(odd, VOCABULARY).collect()
    assert order((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == order(expected)

    keys = {}
    for doc_id, text, *_ in ODD:
        for line in (text or "").split("\n"):
            key = fold(line.strip(" \t\n\x0b\x0c\r"))
            if doc_id is not None and len(key) >= 10:
                keys.setdefault(key, set()).add(doc_id)
    expected = []
    for doc_id, text, *_ in ODD:
        lines = (text or "").split("\n")
        owners = [keys.get(fold(line.strip(" \t\n\x0b\x0c\r")), set()) for line in lines]
        kept = [x for x, own in zip(lines, owners, strict=True) if doc_id is None or not own or min(own) == doc_id]
        expected.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.dedup_lines(odd, Scratch(spark, "t")).collect()
    assert order((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == order(expected)

    sizes = [(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in ODD]
    mixed = mixing.mix_sources(odd, Scratch(spark, "t")).collect()
    assert order((r.doc_id, r.source, r.size) for r in mixed) == order(sizes)
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in mixed)
    for source in ("a", "b", None):
        mine = [r for r in mixed if r.source == source]
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    outputs = [
        jaccard.jaccard_join(none, Scratch(spark, "t")),
        linededup.dedup_lines(none, Scratch(spark, "t")),
        mixing.mix_sources(none, Scratch(spark, "t")),
        bpe.round_trip(none, VOCABULARY),
        fertility.judge(none, Scratch(spark, "t"), public_tokenizers.path("piece_bpe_32k.model")),
        toxicity.score_documents(none, toxicity.learn(none, labels, Scratch(spark, "t"))),
        kneser.classify(none, labels, Scratch(spark, "t")),
        htmltext.extract(pages, Scratch(spark, "t")),
        warc.captures(pages, Scratch(spark, "t")),
        embeddings.near_duplicates(vectors, Scratch(spark, "t")),
    ]
    assert all(frame.isEmpty() for frame in outputs)


def test_pipeline(spark, documents):
    """Stage by stage: what a stage may drop, and what the end holds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, scratch = docs.columns, Scratch(spark, "t")
    text = {d: t for d, t, _ in documents}
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.save(stage(spark, before, SF), f"s{place}")
        if place < 4:
            assert docs.columns == names
        if place == 0:
            assert 0.8 * before.count() <= docs.count() <= before.count()
        if place == 1:
            assert docs.count() == before.count()
            assert all(len(r.text or "") <= len(text[r.doc_id] or "") for r in docs.collect())
        if place == 2:
            groups = jaccard_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, (_, g) in groups.items() if d == g)
    hashes = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect()}
    final = docs.collect()
    assert len(final) == before.count() and all(r.decoded_sha256 == hashes[r.doc_id] for r in final)


def test_long_words_are_encoded_as_the_library_does(spark):
    """Words far longer than a recursion could hold: repeats that overlap, random letters, unspaced scripts."""
    rng = random.Random(1)
    texts = [
        "a" * 1001 + " " + "ab" * 999 + "!?" * 1000 + "." * 999,
        "".join(rng.choice("acgt") for _ in range(100_000)),
        "".join(rng.choice("abcdefgh") for _ in range(600)),
        "漢字仮名" * 500 + " " + "é" * 700,
        " ".join("".join(rng.choice("0123456789abcdef") for _ in range(400)) for _ in range(20)),
    ]
    ranks = bpe.read_ranks(VOCABULARY)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.round_trip(docs, VOCABULARY, ids=True).collect()}
    for k, text in enumerate(texts):
        assert list(got[k].ids) == plain.encode_ordinary(text)
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_keeps_no_database_between_tasks():
    """What a worker holds while it goes on to other steps are the words it met, not DuckDB's memory."""
    ranks = bpe.read_ranks(VOCABULARY)

    class Shared:
        key = "test"

        class ranks:
            value = ranks

    words = b" zqxvkj wpfthq " + b"qzx" * 200
    raw, offs = np.frombuffer(words, np.uint8), np.array([0, len(words)])
    with bpe._encoder(Shared) as encoder:
        first = [part.tolist() for part in encoder.encode(raw, offs)]
        assert encoder._con is not None
    assert encoder._con is None
    with bpe._encoder(Shared) as again:
        assert again is encoder and [part.tolist() for part in again.encode(raw, offs)] == first
        assert again._con is None  # every word is remembered
        more = np.frombuffer(b"jqvzwk", np.uint8)
        assert again.decode([again.encode(more, np.array([0, 6]))[0].tolist()]) == [b"jqvzwk"]
    bpe._encoders.clear()
