"""Collocations against SQL and a plain count."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import collocations
from pageloom.llm.oracles import ORACLES
from pageloom.llm.queries import QUERIES
from pageloom.llm.storage import Scratch

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
NAME = "op12_phrase_collocations"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    wanted = con.execute(ORACLES[NAME])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(COLUMNS)
    got = sorted(tuple(r[c] for c in names) for r in QUERIES[NAME](spark, f"/root/testdata/{sf}").collect())
    assert got == sorted(wanted.fetchall()) and len(got) > 100


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plainly(docs, longest, least, percent, top):
    f, total = Counter(), Counter()
    for _, lang, text in docs:
        lang = lang or "und" if lang != "" else ""
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, words), a in found.items():
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        covered = any(
            other == lang
            and len(more) > len(words)
            and 100 * b >= percent * a
            and any(more[i : i + len(words)] == words for i in range(len(more)))
            for (other, more), b in found.items()
        )
        if not covered:
            row = (-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]])
            out.setdefault(lang, []).append(row)
    return sorted(
        (lang, n, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for n, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


ODD = [
    (None, None, None),
    (None, "und", "one two three four. " * 7),
    (1, None, "one two three four? one\ttwo  three\nfour " * 4),
    (1, None, "One TWO three"),
    (2, "", "x y " * 30),
    (2, "", "x y " * 30),
    (3, "fr", "é漢 🙂 É漢 ; é漢 🙂" * 12),
    (4, "fr", ""),
    (5, "de", " \t\x0b. ,"),
    (6, "de", "a" * 300_000 + " b " + "a" * 300_000 + " b"),
    (7, "en", "w1 w2 w3 w4 w5 " * 2000),
    (8, "en", " ".join(f"q{k % 37}" for k in range(20_000))),
    (9, "en", " a b c d " * 11),
]


@pytest.mark.parametrize(("longest", "least", "percent", "top"), [(3, 10, 50, 2000), (4, 3, 80, 25), (2, 1, 50, 9)])
def test_odd_texts_against_a_plain_count(spark, longest, least, percent, top):
    """Nulls, empty and long texts, overlaps, copies of a row, blanks that are not blanks here, clashing names."""
    docs = spark.createDataFrame(ODD, "doc_id long, lang string, text string")
    docs = docs.withColumns({c: F.lit("z") for c in ("shard", "key", "n", "phrase")})
    got = collocations.collocations(docs, Scratch(spark, "t"), longest, least, percent, top)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plainly(ODD, longest, least, percent, top)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(docs, Scratch(spark, "t")).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 4_000_000_000_000
    rows = [("x", 0, "", 9 * big), ("x", 1, "a", big), ("x", 1, "b", big - 1), ("x", 2, "a b", big - 7)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    monkeypatch.setattr(collocations, "count_phrases", lambda *_: counts)
    got = collocations.collocations(None, Scratch(spark, "t")).collect()
    assert [r.score for r in got] == [10**6 * (big - 7) ** 2 // (big * (big - 1))]


def test_filter_never_says_no_to_what_it_holds(spark):
    keys = np.random.default_rng(1).integers(0, 2**62, 5000, dtype=np.uint64)
    frame = spark.createDataFrame(pa.table({"key": pa.array(keys.view(np.int64))}).to_pandas())
    held = collocations.Filter(collocations.filter_bits(frame))
    assert held(keys).all()
    others = np.random.default_rng(2).integers(0, 2**62, 5000, dtype=np.uint64)
    assert held(others).mean() < 0.01


def test_numbers_of_words_do_not_rest_on_hashes(monkeypatch):
    texts, langs = pa.array(["a b a", "a c b"]), ["x", "y"]
    right = collocations.Words(texts, langs).numbers()
    words = collocations.Words(texts, langs)
    words.hash[:] = 1
    words.seed[:] = 1
    for found in (right, words.numbers()):
        assert found[0] == found[2] and len(set(found.tolist())) == 5


@pytest.mark.parametrize("n", [0, 1, 2, 500, 70_000])
def test_hashes_are_read_as_they_were_written(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
    assert np.array_equal(collocations._read(collocations._written(keys)), keys)


def test_shares_of_shards_lose_no_phrase(spark, monkeypatch):
    """All that is frequent is found when a phrase lies in one shard or in all alike, whatever their sizes."""
    rows = [(k, "x", "solid pair. ") for k in range(10)] + [(77, "x", "other pair . " * 10), (78, "x", "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.phrase: r.n for r in collocations.count_phrases(docs, Scratch(spark, "t"), 2, 10).collect()}
    assert got["solid pair"] == 10 and got["other pair"] == 10 and got["word word"] == 4999
