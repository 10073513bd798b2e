"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback tells how natural a text looks to a model: characters per token, the
share of tokens that are fallback bytes, and the entropy of the tokens. Texts are measured word by word (a
word's tokens are those of the word alone), and each language, or script where no language is given, gets
rejection bands from the quartiles of all its documents of like length. Base rules come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch
from pageloom.llm.textops import SPACE, mix, per_text, ragged, slices, span_hashes, text_bytes, windows, word_spans

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Words a worker remembers.
MEMO = 1_000_000
# A band reaches so many interquartile ranges beyond the quartiles; a range counts as at least a share of the median.
REACH = 4.0
LEAST_RANGE = 0.02
# A group of fewer documents takes the bands of all documents of its length.
LEAST_ROWS = 30

SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, n_tokens long, n_bytes long, entropy double"
)


class Words:
    """Token ids of words, remembered as sorted arrays."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def spans(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray):
        """Start and count in ``ids`` of each word's tokens."""
        if len(self.keys) > MEMO:
            self.forget()
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        if not known.all():
            data = raw.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(first[index[~known]], last[index[~known]], strict=True)]
            found = self.model.encode(texts, num_threads=1)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate((self.ids, np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))))
            at = place[~known]
            self.keys = np.insert(self.keys, at, unique[~known])
            self.start, self.count = np.insert(self.start, at, starts), np.insert(self.count, at, counts)
            place = np.searchsorted(self.keys, unique)
        return self.start[place][inverse], self.count[place][inverse]


def repeated_words(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of three that are found twice or more in their text."""
    value, at = windows(words, doc, 3)
    key = mix(value ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[counts[inverse] >= 2]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return per_text(doc[covered], n)


def repeated_lines(raw: np.ndarray, offs: np.ndarray, words_at: np.ndarray, doc_of_word: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(offs) - 1
    ends = np.flatnonzero(raw == 0x0A)
    first = np.unique(np.concatenate((offs[:-1], ends + 1)))
    first = first[first < len(raw)]  # what starts at the end is empty
    closed = np.append(ends, len(raw))
    last = np.minimum(closed[np.searchsorted(ends, first)], offs[np.searchsorted(offs, first, side="right")])
    line = np.searchsorted(first, words_at, side="right") - 1
    full = np.unique(line)
    first, last = first[full], last[full]
    doc = np.searchsorted(offs, first, side="right") - 1
    key = mix(span_hashes(raw, first, last) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    once = np.unique(key, return_index=True)[1]
    return per_text(doc, n) - per_text(doc[once], n)


def entropies(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Entropy in bits of the token ids of each text."""
    key, counts = np.unique(doc.astype(np.int64) << 32 | ids, return_counts=True)
    owner = key >> 32
    total = np.bincount(doc, minlength=n).astype(np.float64)
    share = counts / total[owner]
    return np.bincount(owner, -share * np.log2(share), minlength=n).astype(np.float64)


def measures(docs: DataFrame, model: bytes) -> DataFrame:
    """Base counts, tokens, fallback bytes and token entropy of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keeper: dict[str, Words] = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = keeper.setdefault("words", Words(shared.value))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                raw, offs = text_bytes(part.column("text"))
                n = len(offs) - 1
                first, last, doc = word_spans(raw, offs)
                words = span_hashes(raw, first, last)
                start, count = known.spans(raw, first, last, words)
                ids = known.ids[ragged(start, count)]
                owner = np.repeat(doc, count)
                chars = np.concatenate(([0], np.cumsum(((raw & 0xC0) != 0x80) & ~SPACE[raw])))
                signs = np.concatenate(([0], np.cumsum(SYMBOLS[raw])))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "lang": part.column("lang"),
                        "n_words": per_text(doc, n),
                        "word_chars": np.diff(chars[offs]).astype(np.int64),
                        "n_symbols": np.diff(signs[offs]).astype(np.int64),
                        "n_dup_lines": repeated_lines(raw, offs, first, doc),
                        "n_repeat_words": repeated_words(words, doc, n),
                        "n_tokens": per_text(owner, n),
                        "n_bytes": per_text(owner[known.byte[ids]], n),
                        "entropy": entropies(ids, owner, n),
                    }
                )

    # Where no language is given the script of the text's first letters stands in.
    letter = F.regexp_extract("text", r"(\p{L})", 1)
    script = F.when(letter.rlike(r"\p{IsLatin}"), "latin").when(letter.rlike(r"\p{IsCyrillic}"), "cyrillic")
    script = script.when(letter.rlike(r"\p{IsHan}"), "han").otherwise("other")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.concat(F.lit("script:"), script)).alias("lang"), "text")
    return rows.mapInArrow(work, SCHEMA)


def judge(docs: DataFrame, scratch: Scratch, model_path: str, reach: float = REACH) -> DataFrame:
    """Base counts, base_failed and kept of every row of ``docs(doc_id, text, lang)``.

    base_failed: fewer than 50 words, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and all
    three measures inside the bands of the language (or script) among documents with as many tokens, to a
    power of two. Null and empty texts have no words and fail. Repeated rows, ties and null ids are rows like
    others; other columns are not looked at; an empty table gives an empty one.
    """
    with open(model_path, "rb") as file:
        model = file.read()  # a vocabulary file has a fixed size
    rows = measures(docs, model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    rows = scratch.save(
        rows.withColumns(
            {
                "base_failed": failed,
                "fit": F.col("word_chars") / tokens,
                "fallback": F.col("n_bytes") / tokens,
                "size": F.floor(F.log2(tokens.cast("double"))).cast("int"),
            }
        ),
        "measures",
    )
    names = ("fit", "fallback", "entropy")
    quarters = [F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in names]
    good = rows.where(~F.col("base_failed"))
    own = good.groupBy("lang", "size").agg(F.count("*").alias("n"), *quarters)
    every = good.groupBy("size").agg(*quarters).select("size", *(F.col(c).alias(f"all_{c}") for c in names))
    bands = own.join(every, "size")
    bands = bands.select(
        "lang", "size", *(F.when(F.col("n") >= LEAST_ROWS, F.col(c)).otherwise(F.col(f"all_{c}")).alias(f"q_{c}") for c in names)
    )
    bands = scratch.save(bands, "bands")
    joined = rows.join(bands, ["lang", "size"], "left")
    inside = F.lit(True)
    for c in names:
        q = F.col(f"q_{c}")
        wide = reach * F.greatest(q[2] - q[0], LEAST_RANGE * F.greatest(q[1], F.lit(0.25)))
        inside = inside & F.col(c).between(q[0] - wide, q[2] + wide)
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.col("fit").alias("chars_per_token"),
        F.col("fallback").alias("fallback_share"),
        F.col("entropy").alias("token_entropy"),
    )
