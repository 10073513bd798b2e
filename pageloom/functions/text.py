"""Text columns: stripping, counting, hashing, keywords, readability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WHITESPACE_RE = (
    "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)
# The same, written so that two looks tell a letter: a set of small code points, and a range around all others.
GAP_RE = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0"
    "[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]]+"
)

# English stop words left out of keywords and of search terms.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from about into through during "
    "before after above below up down out off over under again further then once is are "
    "was were be been being have has had do does did will would could should may might "
    "must can this that these those i you he she it we they them their what which who "
    "when where why how"
).split()

# A run of two or more ASCII letters that touches no other word character.
WORD_RE = "(?<![\\p{L}\\p{N}_])[a-zA-Z]{2,}(?![\\p{L}\\p{N}_])"

# A whole word of letters, digits and underscores.
TERM_RE = "[\\p{L}\\p{N}_]+"

WORDS_PER_MINUTE = 200
MAX_KEYWORDS = 20


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def word_count(text: Column) -> Column:
    """Words between white space: white space at an end leaves an empty part there, which is not one."""

    def of(parts: Column) -> Column:
        first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
        return (F.size(parts) - first - last).cast("long")

    return bind(F.split(text, GAP_RE), of)


def reading_time(words: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(words / F.lit(WORDS_PER_MINUTE)))


def content_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def searchable_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def terms(text: Column) -> Column:
    """Lower-case words of a text in order, without stop words."""
    return _without_stop_words(F.regexp_extract_all(F.lower(text), F.lit(WORD_RE), F.lit(0)))


def index_terms(text: Column) -> Column:
    """Search terms: as ``terms``, but letters of any script, digits and ``_``."""
    return _without_stop_words(F.regexp_extract_all(F.lower(text), F.lit(TERM_RE), F.lit(0)))


def _without_stop_words(words: Column) -> Column:
    names = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return F.call_function("filter", words, F.expr(f"w -> w NOT IN ({names})"))


def word_frequencies(words: Column) -> Column:
    """Distinct words of an array as (n, pos, word): count and first position.

    Works inside the row, so counting the words of a page needs no shuffle: sort
    (word, position), find where each run of equal words starts, and read count
    and first position off the run.
    """

    def counted(pairs: Column) -> Column:
        def is_start(i: Column) -> Column:
            return (i == 0) | (F.get(pairs, i)["word"] != F.get(pairs, i - 1)["word"])

        def runs(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda start, nth: F.struct(
                    (F.coalesce(F.get(starts, nth + 1), F.size(pairs)) - start).alias("n"),
                    F.get(pairs, start)["pos"].alias("pos"),
                    F.get(pairs, start)["word"].alias("word"),
                ),
            )

        positions = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.size(pairs) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return bind(F.filter(positions, is_start), runs)

    pairs = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    return bind(F.sort_array(pairs), counted)


def keywords(text: Column, k: int = MAX_KEYWORDS) -> Column:
    """The ``k`` most frequent terms; ties go to the term seen first."""
    ranked = F.transform(
        word_frequencies(terms(text)),
        lambda w: F.struct((-w["n"]).alias("rank"), w["pos"].alias("pos"), w["word"].alias("word")),
    )
    return F.slice(F.sort_array(ranked), 1, k)["word"]


def sentence_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) + F.lit(1)


def readability(text: Column) -> Column:
    """100 less two points per word of average sentence length, at least 0."""

    def score(t: Column) -> Column:
        def of(words: Column) -> Column:
            mean = words / sentence_count(t)
            return F.when(words > 0, F.greatest(F.lit(0.0), F.lit(100.0) - mean * 2)).otherwise(F.lit(0.0))

        return bind(word_count(t), of)

    return bind(text, score)
