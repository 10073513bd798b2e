"""Patterns from a table against all of them tried one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.operators import patterns
from pageloom.operators.patterns import excluded_by_table, required_runs


@pytest.mark.parametrize(
    ("pattern", "runs"),
    [
        ("/admin/", ["/admin/"]),
        ("^https?://", ["http", "://"]),
        ("a|b", []),
        ("foo(?:bar)+baz", ["foo", "bar", "baz"]),
        ("(abc)def", ["abcdef"]),
        ("x*abc?", ["ab"]),
        ("[0-9]+$", []),
        ("(?i)abc", []),
        ("(?i:abc)d", ["d"]),
        ("a{2}bcd", ["a", "bcd"]),
        ("(?=look)abc", ["abc"]),
        ("(?!look)abc", ["abc"]),
        ("\\.pdf$", [".pdf"]),
        ("\\p{L}abc", []),
        ("(", []),
        ("", []),
    ],
)
def test_required_runs(pattern, runs):
    assert required_runs(pattern) == runs


def one_by_one(url, every):
    return url is not None and any(re.search(p, url) for p in every)


@pytest.mark.parametrize("gram", [4, 2])
def test_table_equals_all_patterns(spark, monkeypatch, gram):
    monkeypatch.setattr(patterns, "GRAM", gram)
    rng = random.Random(gram)
    letters = "abc/.-1"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(300)]
    urls = [*made, None, "", "http://a.com/é?x=漢字", made[0], made[0]]
    shapes = ["{}", "^{}", "{}$", "{}[0-9]+", "({}|zz)c", "{}.*{}", "(?:{})+/", "[{}]{{9}}", "(?i){}", "{}?a"]
    every = {
        rng.choice(shapes).replace("{}", "X").replace("{{", "{").replace("}}", "}").replace(
            "X", re.escape("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))))
        )
        for _ in range(120)
    }
    every |= {"漢", "never-there-at-all"}
    rows = spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "url string, gram int")
    table = spark.createDataFrame([(p, "x") for p in [*every, None]], "pattern string, gram string")
    got = {r.gram: r.is_excluded for r in excluded_by_table(rows, table).collect()}
    assert got == {k: one_by_one(u, every) for k, u in enumerate(urls)}
    assert 5 < sum(got.values()) < len(urls) - 5


def test_very_many_patterns(spark):
    rows = spark.range(5000).select(F.concat(F.lit("http://a.com/p/"), "id", F.lit("/x")).alias("url"))
    table = spark.range(100_000).select(F.concat(F.lit("^https?://a\\.com/p/"), F.col("id") * 2, F.lit("/")).alias("pattern"))
    got = excluded_by_table(rows, table).where("is_excluded")
    assert got.count() == 2500


def test_no_patterns_and_too_many_open_ones(spark, monkeypatch):
    rows = spark.createDataFrame([("http://a.com",)], "url string")
    none = spark.createDataFrame([], "pattern string")
    assert [r.is_excluded for r in excluded_by_table(rows, none).collect()] == [False]
    monkeypatch.setattr(patterns, "MOST_OPEN", 1)
    table = spark.createDataFrame([("[0-9]",), ("[a-z]$",)], "pattern string")
    with pytest.raises(ValueError, match="require no text"):
        excluded_by_table(rows, table)
