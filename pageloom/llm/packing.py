"""Lexical retrieval packing: windows of a training sequence filled with documents that read alike.

Documents are encoded where they are read. What fills whole windows by itself stays there; the rest of each
document, less than one window, is a unit. Units are dealt to shards of at most ``UNITS``, in the order they
are read, and every shard is an inverted index of its units' tokens with BM25 weights. A seed unit opens a
window, the index returns its unused neighbours, best first, and they fill the window greedily; the last one is
cut where the window ends, and what is left of it seeds the next. What remains at the end of a shard, less
than a window, becomes sequences whose lengths are powers of two, which need no padding.

How many documents hold a token, how many there are and how long units are on average is counted over all
documents; that table has one row per vocabulary entry at most, so it is sent to every task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm.shipping import ship
from pageloom.llm.storage import Scratch
from pageloom.llm.textops import ragged, slices

WINDOW = 1024
UNITS = 512
SLICE = 2 << 20
# The usual constants of BM25.
K1, B = 1.2, 0.75
# Bits of a number within a task's shards, and of a sequence within a shard.
SHARD_BITS, SEQUENCE_BITS = 17, 26


# The pattern by which byte-level files cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level files write bytes with: visible Latin-1 ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_of(specification: str) -> dict[bytes, int] | None:
    """The vocabulary of a plain byte-level file as ranks; None if merging by rank could give other ids.

    Plain means no rules for texts but the pattern, every byte a token, and merges listed in the order of the
    ids they make, so that the pair to merge first is the one whose token has the smallest id.
    """
    rules = json.loads(specification)
    cut, model = rules.get("pre_tokenizer") or {}, rules["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", False)
    if not plain or rules.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges"):
        return None
    vocab, alphabet = model["vocab"], byte_of_char()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if any(set(t) - alphabet.keys() for t in vocab) or made != sorted(made):
        return None
    ranks = {bytes(alphabet[c] for c in token): number for token, number in vocab.items()}
    return ranks if all(bytes([b]) in ranks for b in range(256)) and len(ranks) == len(pairs) + 256 else None


class Encoder:
    """Texts to ids by a ``tokenizers`` file.

    Where the file is a plain byte-level one, its merges are made by the faster of two libraries with the same
    result; the first text of every call is encoded by both and must be equal.
    """

    def __init__(self, specification: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(specification)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        ranks = ranks_of(specification)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _plainly(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        encode = self.fast.encode_ordinary if self.fast else self._plainly
        found = [encode(text) if text else [] for text in texts]
        if self.fast:
            first = next((k for k, text in enumerate(texts) if text), None)
            if first is not None and self._plainly(texts[first]) != found[first]:
                raise RuntimeError("two libraries read the vocabulary differently")
        return [np.array(ids, dtype=np.uint32) for ids in found]


_encoders: dict[int, Encoder] = {}


def _encoder(specification) -> Encoder:
    """The worker's encoder; loading a file takes longer than encoding a small task's texts."""
    key = hash(specification.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(specification.value)
    return _encoders[key]


def _units(docs: DataFrame, specification, end: int, window: int, width: str) -> DataFrame:
    """Encoded documents dealt to shards, and (token, n) rows: in how many of a task's documents a token is.

    body is what fills whole windows, tail the rest; both are ids of ``width``. first is the number within
    its shard of the document's first whole window, place its order there.
    """
    doc_type = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(specification)
        size = encoder.tokenizer.get_vocab_size()
        last = np.array([end], dtype=np.uint32)
        shard, place, first = TaskContext.get().partitionId() << SHARD_BITS, 0, 0
        held = np.zeros(max(size, end + 1), dtype=np.int64)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch, "text", SLICE):
                columns: list[list] = [[] for _ in range(6)]
                for ids in encoder.encode(part.column("text").to_pylist()):
                    tokens = np.concatenate((ids, last))
                    held[tokens] += 1  # once for equal ones
                    if place == UNITS:
                        shard, place, first = shard + 1, 0, 0
                    whole = len(tokens) // window * window
                    narrow = tokens.astype(width)
                    row = (shard, place, first, len(tokens), narrow[:whole].tobytes(), narrow[whole:].tobytes())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    place, first = place + 1, first + whole // window
                yield _unit_rows(part.column("doc_id"), columns, part.num_rows)
        seen = np.flatnonzero(held)
        yield _unit_rows(pa.nulls(len(seen), kind), [[None] * len(seen)] * 6, len(seen), seen, held[seen])

    schema = (
        f"doc_id {doc_type.simpleString()}, shard long, place long, first long, doc_tokens long, "
        "body binary, tail binary, token int, n long"
    )
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _unit_rows(doc_ids: pa.Array, columns: list, rows: int, tokens=None, counts=None) -> pa.RecordBatch:
    names = ["doc_id", "shard", "place", "first", "doc_tokens", "body", "tail", "token", "n"]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2
    arrays = [doc_ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
    arrays.append(pa.nulls(rows, pa.int32()) if tokens is None else pa.array(tokens.astype(np.int32)))
    arrays.append(pa.nulls(rows, pa.int64()) if counts is None else pa.array(counts))
    return pa.record_batch(arrays, names=names)


class Index:
    """An inverted index of some units: posting lists by token, each posting with its BM25 weight."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = len(units)
        lens = np.array([len(u) for u in units], dtype=np.int64)
        tokens = np.concatenate(units).astype(np.int64) if n else np.empty(0, np.int64)
        pairs, tf = np.unique(np.repeat(np.arange(n), lens) * len(idf) + tokens, return_counts=True)
        unit, token = np.divmod(pairs, len(idf))
        weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[unit] / mean))
        self.n = n
        self.own = np.searchsorted(unit, np.arange(n + 1))
        self.token = token
        order = np.argsort(token, kind="stable")
        self.unit, self.weight = unit[order], weight[order]
        begin = np.searchsorted(token[order], np.arange(len(idf) + 1))
        self.begin, self.length = begin[:-1], np.diff(begin)

    def neighbours(self, seed: int) -> np.ndarray:
        """All units, best first by the BM25 score of the seed's tokens; equal scores by their order."""
        terms = self.token[self.own[seed] : self.own[seed + 1]]
        at = ragged(self.begin[terms], self.length[terms])
        scores = np.bincount(self.unit[at], self.weight[at], minlength=self.n)
        return np.argsort(-scores, kind="stable")


def fill(units: list[np.ndarray], index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (unit, from, length) pieces: full windows, then powers of two for what remains."""
    left = np.array([len(u) for u in units], dtype=np.int64)
    done = np.zeros(len(units), dtype=np.int64)
    sequences: list[list[tuple[int, int, int]]] = []
    upcoming, cut = 0, -1
    while True:
        seed, cut = cut, -1
        if seed < 0:
            while upcoming < len(units) and not left[upcoming]:
                upcoming += 1
            if upcoming == len(units):
                return sequences
            seed = upcoming
        pieces, room = [], window

        def take(unit: int, pieces: list = pieces) -> int:
            n = int(min(room, left[unit]))
            pieces.append((unit, int(done[unit]), n))
            done[unit] += n
            left[unit] -= n
            return n

        room -= take(seed)
        last = seed
        if room and left.any():
            for unit in index.neighbours(seed).tolist():
                if left[unit]:
                    room -= take(unit)
                    last = unit
                    if not room:
                        break
        if left[last]:
            cut = last
        sequences.extend([pieces] if not room else _powers(pieces))


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The same pieces as sequences whose lengths are powers of two, the largest first."""
    total = sum(n for _, _, n in pieces)
    waiting = list(reversed(pieces))
    for power in reversed(range(total.bit_length())):
        room = total & (1 << power)
        sequence = []
        while room:
            unit, start, n = waiting.pop()
            taken = min(room, n)
            sequence.append((unit, start, taken))
            if taken < n:
                waiting.append((unit, start + taken, n - taken))
            room -= taken
        if sequence:
            yield sequence


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(doc_ids: pa.Array, rows: Iterable[tuple]) -> pa.Table:
    names = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.table([doc_ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, window: int = WINDOW, end: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids.

    ``vocabulary`` is a ``tokenizers`` file; a document is its ids without special tokens, then ``end``. start
    is where a piece begins in its document, offset where in its sequence; ids are little-endian unsigned
    32-bit integers. Sequences are ``window`` long or a power of two. A null text is empty and has one piece
    with ``end``; a null doc_id and repeated rows are documents of their own. Ties of BM25 scores go to the
    document read first. Long texts are encoded whole. An empty table gives an empty one; columns other than
    doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    specification = spark.sparkContext.broadcast(text)
    size = max(Tokenizer.from_str(text).get_vocab_size(), end + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = scratch.save(_units(docs, specification, end, window, width), "units")
    units = rows.where(F.col("shard").isNotNull()).drop("token", "n")
    holders = rows.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    tokens = F.octet_length("tail") / np.dtype(width).itemsize
    count, mean = units.agg(F.count("*"), F.avg(F.when(tokens > 0, tokens))).first()
    n = np.zeros(size)
    n[holders["token"].to_numpy(dtype=np.int64)] = holders["n"].to_numpy(dtype=np.float64)
    idf = spark.sparkContext.broadcast(np.log1p((count - n + 0.5) / (n + 0.5)))
    mean = mean or 1.0
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", SLICE):
                index, out = [], []
                columns = [part.column(c).to_pylist() for c in ("shard", "first", "doc_tokens", "body")]
                for k, (shard, first, total, body) in enumerate(zip(*columns, strict=True)):
                    ids = np.frombuffer(body, dtype=width).astype("<u4")
                    for w in range(len(ids) // window):
                        piece = ids[w * window : (w + 1) * window].tobytes()
                        out.append((w * window, window, total, shard << SEQUENCE_BITS | first + w, 0, piece))
                        index.append(k)
                yield from _pieces(part.column("doc_id").take(pa.array(index, pa.int64())), out).to_batches()

    def shard_pieces(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        shard = table.column("shard")[0].as_py()
        tails = [np.frombuffer(t, dtype=width) for t in table.column("tail").to_pylist()]
        totals = table.column("doc_tokens").to_pylist()
        number = (shard << SEQUENCE_BITS) + sum(t // window for t in totals)
        index, out = [], []
        for sequence in fill(tails, Index(tails, idf.value, mean), window):
            offset = 0
            for unit, start, length in sequence:
                ids = tails[unit][start : start + length].astype("<u4").tobytes()
                out.append((totals[unit] // window * window + start, length, totals[unit], number, offset, ids))
                index.append(unit)
                offset += length
            number += 1
        return _pieces(table.column("doc_id").take(pa.array(index, pa.int64())).combine_chunks(), out)

    schema = f"doc_id {doc_type}, {PIECES}"
    long = units.where(F.octet_length("body") > 0).select("doc_id", "shard", "first", "doc_tokens", "body")
    short = units.select("doc_id", "shard", "place", "doc_tokens", "tail")
    return long.mapInArrow(whole, schema).unionAll(short.groupBy("shard").applyInArrow(shard_pieces, schema))
