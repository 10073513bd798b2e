"""Text expressions against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import text

TEXTS = [
    "",
    " \t\n",
    "one",
    " The cat and the Cat sat on  a mat. ",
    "b a b a c",
    "café naïve abc éabc abc_ abc1 abc-def don't",
    "No full stop",
    "A. B. C. D.",
    "z\x1cy\x85x",
    " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) * 2,
]


def expected_keywords(value, k=20):
    words = re.findall(r"\b[a-zA-Z]{2,}\b", value.lower())
    kept = Counter(w for w in words if w not in text.STOP_WORDS)
    return [w for w, _ in kept.most_common(k)]


def expected_readability(value):
    words = value.split()
    return max(0, 100 - len(words) / len(value.split(".")) * 2) if words else 0


def compute(spark, values):
    t = F.col("t")
    return (
        spark.createDataFrame(list(enumerate(values)), "i int, t string")
        .select(
            "t",
            text.word_count(t).alias("words"),
            text.strip(t).alias("stripped"),
            text.keywords(t).alias("keywords"),
            text.readability(t).alias("readability"),
            text.content_hash(t).alias("hash"),
            text.reading_time(text.word_count(t)).alias("minutes"),
        )
        .collect()
    )


def check(rows):
    for r in rows:
        assert r.words == len(r.t.split())
        assert r.stripped == r.t.strip()
        assert r.keywords == expected_keywords(r.t)
        assert r.readability == pytest.approx(expected_readability(r.t))
        assert r.hash == hashlib.md5(r.t.encode()).hexdigest()
        assert r.minutes == max(1, len(r.t.split()) // 200)


def test_texts(spark):
    check(compute(spark, TEXTS))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab Z.\né_1 ", max_size=60), min_size=30, max_size=40))
def test_random_texts(spark, values):
    check(compute(spark, values))


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(compute(spark, [r.text for r in rows.select("text").collect()]))


def test_stop_words():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 74


def test_every_white_space_is_stripped(spark):
    every = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert set(text.WHITESPACE) == set(every)
    row = compute(spark, [every + "x" + every + "y"])[0]
    assert (row.words, row.stripped) == (2, "x" + every + "y")


def test_index_terms(spark):
    row = spark.createDataFrame([("The Été of 42 foo_bar, foo",)], "t string").select(
        text.index_terms(F.col("t")).alias("terms")
    )
    assert row.first().terms == ["été", "42", "foo_bar", "foo"]


def test_words_are_counted_without_a_copy_of_the_text(spark):
    """As many as Python finds, whatever white space is at the ends; the text is not trimmed first (F13, F15, F23)."""
    samples = ["", " ", "a", " a", "a ", "\xa0a\u3000b\x1c", "\u200b", "a\u2009\n b\x85", "\t\u2028", "x" * 9, None]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.word_count(F.col("t")).alias("n"))
    assert "trim(" not in rows._jdf.queryExecution().analyzed().toString()
    assert [(r.t, r.n) for r in rows.collect()] == [(s, None if s is None else len(s.split())) for s in samples]
