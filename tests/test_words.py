"""Words counted and placed by batch, against the expressions of Spark and plain Python."""

import random

from pyspark.sql import functions as F

from pageloom.functions import text, words
from pageloom.operators.saving import PageStore
from pageloom.plans import inputs, textindex
from pageloom.session import conf_set
from pageloom.sources.store import Store

SF = "/root/testdata/sf0.001"
# Scripts, digits and marks of several ages of Unicode, and what lower case makes longer.
ODD = "aZé²½ªÀßŒİẞΣςЖあ中한ʰ१Ⅷ１_-'’“—€́­​԰ࡰᷰ0"
FAR = "".join(map(chr, (0x1D400, 0x1DF00, 0x1E030, 0x1E900, 0x1F600, 0x2EBF0, 0x31350)))
TEXTS = [
    "",
    " ",
    None,
    "one",
    "the THE of a b",
    " b a b a ccc ccc bb bb",
    "abc éabc abc_ abc1 abc-abc don't abc\xa0abc",
    "z\x1cy\x85x  w v\nu",
    "ΟΔΟΣ ΟΔΟΣ. İstanbul istanbul",
    "a" * 300 + " " + "ab " * 50 + "ba " * 50,
    " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) * 2,
]


def odd_texts(seed, n=150, odd=ODD + FAR):
    rng = random.Random(seed)
    letters = ["ab", "the", "  ", " ", " ", "\n", "ca", ".", *odd]
    return ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def test_counts_are_those_of_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(words, "RUN_LETTERS", 200)
    t, texts = F.col("t"), TEXTS + odd_texts(1, odd=ODD)
    rows = frame(spark, texts).select(
        "i",
        words.counted(spark, t).alias("found"),
        text.word_count(t).alias("words"),
        text.keywords(t).alias("keywords"),
    )
    for r in rows.collect():
        assert (r.found.words, r.found.keywords) == (r.words, r.keywords), texts[r.i]


def test_a_word_that_touches_a_letter_of_a_far_plane_is_none(spark):
    """As the SQL has it, which cuts at what makes no word; Java looks back over half a character only."""
    row = frame(spark, [f"{chr(0x1E900)}cd ef{chr(0x1D400)} gh{chr(0x1F600)}ij"]).select(words.counted(spark, F.col("t")).alias("c")).first()
    assert (row.c.words, row.c.keywords) == (3, ["gh", "ij"])


def test_every_character_is_what_spark_says(spark):
    """Beside a letter, and as letters of a word of their own; lower case comes first."""
    every = [chr(c) for c in range(words.CODES) if not 0xD800 <= c < 0xE000]
    parts = ["".join(f"ab{c}cd {c} " for c in every[k : k + 4000]) for k in range(0, len(every), 4000)]
    t = F.col("t")
    rows = frame(spark, parts).select(
        words.counted(spark, t)["words"].alias("found"),
        text.word_count(t).alias("words"),
        F.regexp_extract_all(F.lower(t), F.lit(text.TERM_RE), F.lit(0)).alias("terms"),
        "i",
    )
    page = [F.struct(t.alias("clean_text")).alias("content"), F.lit("").alias("title")]
    none = F.struct(F.array().cast("array<string>").alias("keywords")).alias("search_fields")
    pages = frame(spark, parts).select(F.col("i").cast("string").alias("_id"), *page, none)
    placed = {}
    for r in textindex.positional_postings(pages).collect():
        for place in r.places:
            placed.setdefault(int(r["_id"]), []).append((place >> 3, r.term))
    for r in rows.collect():
        assert r.found == r.words
        assert [term for _, term in sorted(placed[r.i])] == r.terms


def expected_postings(spark, rows):
    """From Spark's words and gaps of every field, grouped in plain Python."""
    found = {}
    fields = ("t", "title", "keys")
    cut = spark.createDataFrame(rows, "id string, t string, title string, keys string").select(
        "id",
        *[F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(text.TERM_RE), F.lit(0)).alias(f"{f}_words") for f in fields],
        *[F.split(F.lower(F.coalesce(f, F.lit(""))), text.TERM_RE).alias(f"{f}_gaps") for f in fields],
    )
    out = []
    for r in cut.collect():
        found = {}
        for number, f in enumerate(fields):
            for i, (word, gap) in enumerate(zip(r[f"{f}_words"], r[f"{f}_gaps"])):
                found.setdefault(word, []).append((i << 3) + (4 if gap == " " else 0) + number)
        out += [(word, r.id, sorted(places)) for word, places in found.items()]
    return sorted(out, key=str)


def test_places_are_those_of_the_expressions(spark, monkeypatch):
    for letters in (60, 1_000_000):
        monkeypatch.setattr(words, "RUN_LETTERS", letters)
        odd = odd_texts(letters)
        texts = TEXTS + odd
        # Some pages share an id, some have none.
        rows = [(None if i % 17 == 0 else f"id{i % 40}", t, odd[i % 90], None if i % 5 == 0 else "ab  ca " * (i % 3)) for i, t in enumerate(texts)]
        pages = spark.createDataFrame(rows, "_id string, t string, title string, keys string").select(
            "_id",
            F.struct(F.col("t").alias("clean_text")).alias("content"),
            "title",
            F.struct(F.split("keys", "\\|").alias("keywords")).alias("search_fields"),
        )
        got = [(r.term, r["_id"], r.places) for r in textindex.positional_postings(pages).collect()]
        assert sorted(got, key=str) == expected_postings(spark, rows)


def test_rows_of_a_batch_come_in_order(spark):
    pages = inputs.page_docs(spark, SF).where("quality_score > 20").coalesce(1)
    rows = textindex.positional_postings(pages).collect()
    runs = sum(1 for a, b in zip(rows, rows[1:]) if (a.term.encode(), a["_id"]) > (b.term.encode(), b["_id"]))
    assert len(rows) > 1000 and runs <= 3


def test_stored_pages_are_counted_and_indexed_without_lambdas(spark):
    """A lambda for every word of every page made the stored pages run out of time on 6 GB (F1-F5)."""
    for pages in (inputs.page_docs(spark, SF), inputs.page_docs_next(spark, SF), textindex.positional_postings(inputs.page_docs(spark, SF))):
        plan = pages._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan
        assert plan.count("ArrowEvalPython") == 1


def test_a_save_sends_few_pages_at_a_time_to_python(spark, tmp_path, monkeypatch):
    """Ten thousand wide rows at a time bring an executor close to its memory (F1-F5)."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(PageStore, "_save", lambda *_: seen.append(spark.conf.get(key)))
    with conf_set(spark, key, "10000"):
        PageStore(Store(spark, str(tmp_path))).save(inputs.page_docs(spark, SF))
        seen.append(spark.conf.get(key))
    assert seen == ["1000", "10000"]


def test_places_of_a_phrase_are_computed_once(spark):
    """A condition on computed places went below their computing and did it twice (F3)."""
    made = [("of", "a", 1, [0, 12]), ("the", "a", 1, [13, 20]), ("of", "b", 1, [8]), ("the", "b", 1, [2])]
    postings = spark.createDataFrame(made, "term string, _id string, commit int, places array<int>")
    found = textindex.phrase_pages(postings, ["of", "the"])
    assert [r["_id"] for r in found.collect()] == ["a"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 2
