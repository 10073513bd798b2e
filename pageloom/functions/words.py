"""Words of whole texts, counted and placed in Python, many texts at a time as arrays of numbers.

Spark puts texts in lower case and says which characters make a word (``text.TERM_RE``), so the words are those of
its own regular expressions in any script.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import text

CODES = 0x110000
# Letters and pages that are put in order at a time. The number of a word times that of its page fits 32 bits: a run
# of several pages has no more letters, and one page alone has fewer words than that.
RUN_LETTERS, RUN_PAGES = 1_000_000, 2048
PLACE = 31
OUTPUT_ROWS = 50_000
COUNTED = T.StructType([T.StructField("words", T.LongType()), T.StructField("keywords", T.ArrayType(T.StringType()))])

_STOP = frozenset(text.STOP_WORDS)
_is_letters = re.compile("[a-z]{2,}").fullmatch
_asked: dict[str, bytes] = {}


def word_characters(spark: SparkSession) -> bytes:
    """One bit per character: does it make a word for the regular expressions of the session's Java?"""
    at = spark.sparkContext.applicationId
    if at not in _asked:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, CODES)]))
        others = spark._jvm.java.util.regex.Pattern.compile(text.TERM_RE).matcher(every).replaceAll("")
        found = np.ones(CODES, bool)
        found[0xD800:0xE000] = False
        found[np.frombuffer(others.encode("utf-32-le"), np.uint32)] = False
        _asked[at] = np.packbits(found).tobytes()
    return _asked[at]


@functools.lru_cache(1)
def _table(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


_BLANK = np.zeros(CODES, bool)
_BLANK[[ord(c) for c in text.WHITESPACE]] = True


@dataclass(frozen=True)
class _Words:
    """Words of some texts in order: which text, the number in it, and the place of the word in ``terms``."""

    terms: list[str]
    code: np.ndarray
    owner: np.ndarray
    nth: np.ndarray
    first: np.ndarray  # of every text's words
    joined: np.ndarray  # after exactly one blank
    parts: np.ndarray  # of every text, between white space


def _cut(texts: list[str], makes_word: np.ndarray) -> _Words:
    whole = "\n".join(["", *texts, ""])
    try:
        codec, letters = "latin-1", np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codec, letters = "utf-32-le", np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
    inside = makes_word[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]) * letters.itemsize
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    begins = np.repeat(bounds[:-1], counts)
    joined = (letters[starts - 1] == ord(" ")) & (inside[starts - 2] | (starts - 1 == begins))
    blank = _BLANK[letters]
    return _Words(
        [term.decode(codec) for term in coded.dictionary.to_pylist()],
        coded.indices.to_numpy().astype(np.int64),
        owner,
        np.arange(len(starts)) - np.repeat(first[:-1], counts),
        first[:-1],
        joined,
        np.diff(np.searchsorted(np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, bounds)),
    )


def _heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal upper parts begin in sorted keys, and these parts."""
    upper = keys >> PLACE
    starts = np.flatnonzero(np.diff(upper, prepend=-1))
    return starts, upper[starts]


def _count(texts: list[str], makes_word: np.ndarray, k: int) -> pa.Array:
    """Words between white space, and the ``k`` most frequent terms, those seen first before others of their count."""
    words = _cut(texts, makes_word)
    kept = np.array([_is_letters(t) is not None and t not in _STOP for t in words.terms], bool)[words.code]
    keys = ((words.owner * len(words.terms) + words.code) << PLACE)[kept] + words.nth[kept]
    keys.sort()
    starts, heads = _heads(keys)
    n = np.diff(starts, append=len(keys))
    owner = heads // max(1, len(words.terms))
    bits = len(words.code).bit_length()
    ranked = (((owner << bits) + (1 << bits) - 1 - n) << bits) + (keys[starts] & ((1 << PLACE) - 1))
    ranked.sort()
    owner, seen = ranked >> 2 * bits, ranked & ((1 << bits) - 1)
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    top = np.arange(len(owner)) - begins[owner] < k
    chosen = words.code[words.first[owner[top]] + seen[top]]
    offsets = np.concatenate([[0], np.cumsum(np.minimum(np.diff(begins), k))]).astype(np.int32)
    keywords = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.terms, pa.string()).take(pa.array(chosen)))
    return pa.StructArray.from_arrays([pa.array(words.parts, pa.int64()), keywords], names=COUNTED.names)


def _runs(rows: Iterator[tuple[int, object]]) -> Iterator[list]:
    """Rows, given with their letters, in lists that are worked on at a time."""
    run, letters = [], 0
    for size, row in rows:
        if run and (letters + size > RUN_LETTERS or len(run) >= RUN_PAGES):
            yield run
            run, letters = [], 0
        run.append(row)
        letters += size
    if run:
        yield run


def counted(spark: SparkSession, body: Column) -> Column:
    """``text.word_count`` and ``text.keywords`` of a text, as one struct."""
    bits = word_characters(spark)

    @F.arrow_udf(COUNTED)
    def count(lowered: pa.Array) -> pa.Array:
        texts = (one.as_py() or "" for one in lowered)
        found = [_count(run, _table(bits), text.MAX_KEYWORDS) for run in _runs((len(t), t) for t in texts)]
        whole = pa.concat_arrays(found) if found else _count([], _table(bits), text.MAX_KEYWORDS)
        n, keywords = whole.flatten()
        # A text that is null has a null count, but no keywords.
        n = pc.if_else(lowered.is_valid(), n, pa.scalar(None, n.type))
        return pa.StructArray.from_arrays([n, keywords], names=COUNTED.names)

    return count(F.lower(body))


def places(pages: DataFrame, fields: list[Column], joined: int, place_bits: int) -> DataFrame:
    """(term, _id, places) of all words of some fields of every page; rows that come after one another are in order.

    A place is the number of the word in its field, then ``joined`` if exactly one blank lies before it and the
    number of the field.
    """
    bits = word_characters(pages.sparkSession)
    lowered = [F.lower(F.coalesce(field, F.lit(""))).alias(f"field_{i}") for i, field in enumerate(fields)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for run in _runs((sum(map(len, row[1:])), row) for row in rows):
            found = _postings(run, _table(bits), joined, place_bits)
            for start in range(0, found.num_rows, OUTPUT_ROWS):
                yield found.slice(start, OUTPUT_ROWS)

    return pages.select("_id", *lowered).mapInArrow(work, "term string, _id string, places array<int>")


def _postings(pages: list[tuple[str | None, ...]], makes_word: np.ndarray, joined: int, place_bits: int) -> pa.RecordBatch:
    """Postings of a few pages by word and page: every word is one number, they are sorted and cut into runs."""
    pages = sorted(pages, key=lambda page: (page[0] is not None, page[0] or ""))
    fields = len(pages[0]) - 1
    words = _cut([field for page in pages for field in page[1:]], makes_word)
    order = sorted(range(len(words.terms)), key=words.terms.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) * len(pages)
    page, field = np.divmod(words.owner, fields)
    keys = ((rank[words.code] + page) << PLACE) + (words.nth << place_bits) + words.joined * joined + field
    keys.sort()
    starts, heads = _heads(keys)
    term, page = np.divmod(heads, len(pages))
    spots = pa.array((keys & ((1 << PLACE) - 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words.terms[i] for i in order], pa.string()).take(pa.array(term)),
            pa.array([page[0] for page in pages], pa.string()).take(pa.array(page)),
            pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), spots),
        ],
        names=["term", "_id", "places"],
    )
