"""Phrase collocation mining by SON partitioning.

Documents are dealt to ``SHARDS`` shards. A phrase that occurs ``least`` times in all occurs, in at least one
shard, no less often than that shard's share of all words asks for; so each shard is mined completely at its
proportionally lowered support, level by level (a phrase is only counted where its two shorter parts were
frequent), the phrases frequent in any shard are united, and one last pass counts all of them exactly.

A shard is a key, not a task: its counts are summed by Spark after every task has added up its own. While
mining, phrases are hashes, sorted and written as gaps, and what passed a level is a Bloom filter of fixed size (``FILTER_BITS``,
built by block in tasks). Both can only let too much through, never too little, and the last pass counts the
phrases themselves, so results are exact whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shipping import ship
from pageloom.llm.storage import ARROW_ROWS, Scratch, settings
from pageloom.llm.textops import mix, ragged, slices, span_hashes, text_bytes

SHARD_BITS = 1
SHARDS = 1 << SHARD_BITS
# Bits of a phrase's hash; shard and hash have 48 in all.
KEY_BITS = 48 - SHARD_BITS
FILTER_BITS = 1 << 27
BLOCK_BITS = 1 << 19
BLOCKS = FILTER_BITS // BLOCK_BITS
SLICE = 1 << 20
# Documents that go to a Python worker at once.
BATCH = 1000
# Hashes a task adds up before it hands counts on, and hashes in one part of a corpus, about.
HELD, PART = 1_000_000, 2_000_000
# Counted phrases a task adds up before it hands them on.
COUNTED = 300_000

# Bytes that end a piece, and bytes between words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"

_ENDS, _WORD, _LOWER = np.zeros(256, bool), np.ones(256, bool), np.arange(256, dtype=np.uint8)
_ENDS[list(ENDS)] = True
_WORD[list(ENDS + BLANKS)] = False
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0xD1342543DE82EF95)


class Words:
    """The words of a slice of texts: where they are, whose they are, and which piece they belong to."""

    def __init__(self, texts: pa.Array, langs: list[str]) -> None:
        raw, offs = text_bytes(texts)
        self.raw = _LOWER[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offs] = True
        inside = _WORD[self.raw]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.first, self.last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offs, self.first, side="right") - 1
        ended = np.cumsum(_ENDS[self.raw], dtype=np.int64)[self.first]
        new = np.ones(len(self.first), dtype=bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (ended[1:] != ended[:-1])
        self.piece = np.cumsum(new)
        names = list(dict.fromkeys(langs))
        codes = {name: k for k, name in enumerate(names)}
        self.langs = names
        self.lang = np.array([codes[x] for x in langs], dtype=np.int64)[self.doc]
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], dtype=np.uint64)
        self.seed = mix(seeds)[self.lang] if len(names) else np.empty(0, np.uint64)
        self.hash = span_hashes(self.raw, self.first, self.last)

    def windows(self, size: int) -> np.ndarray:
        """First word of every run of ``size`` words within a piece."""
        n = max(0, len(self.first) - size + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the phrases of ``size`` words at ``at``, language included, of ``KEY_BITS`` bits."""
        value = self.seed[at]
        for k in range(size):
            value = mix(value * _STEP + self.hash[at + k])
        return value >> np.uint64(64 - KEY_BITS)

    def numbers(self) -> np.ndarray:
        """A number per word: equal for equal words of one language, compared by their bytes."""
        hashes = mix(self.seed * _STEP + self.hash)
        _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        model, lens = index[inverse], self.last - self.first
        same = np.array_equal(lens, lens[model]) and np.array_equal(self.lang, self.lang[model])
        if same:
            bytes_of = ragged(self.first, lens)
            same = np.array_equal(self.raw[bytes_of], self.raw[ragged(self.first[model], lens)])
        if same:
            return inverse
        known: dict[tuple[int, bytes], int] = {}
        text = self.raw.tobytes()
        spans = zip(self.lang.tolist(), self.first.tolist(), self.last.tolist(), strict=True)
        return np.array([known.setdefault((c, text[a:b]), len(known)) for c, a, b in spans], dtype=np.int64)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The words at each place, joined by single blanks."""
        raw = np.append(self.raw, np.uint8(0x20))
        begin = np.full((len(at), 2 * size - 1), len(self.raw), dtype=np.int64)
        lens = np.ones_like(begin)
        for k in range(size):
            begin[:, 2 * k] = self.first[at + k]
            lens[:, 2 * k] = (self.last - self.first)[at + k]
        data = raw[ragged(begin.ravel(), lens.ravel())]
        ends = np.concatenate(([0], np.cumsum(lens.sum(axis=1), dtype=np.int64)))
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())]
        return pa.Array.from_buffers(pa.large_string(), len(at), buffers).cast(pa.string())


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each key and its two bits there."""
    h = mix(keys)
    block = (h >> np.uint64(40)) % np.uint64(BLOCKS)
    return block.astype(np.int64), (h % np.uint64(BLOCK_BITS)).astype(np.int64), (h >> np.uint64(20)) % np.uint64(BLOCK_BITS)


class Filter:
    """A Bloom filter of phrase keys: never says no to one it was given."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        block, one, two = _bits(keys)
        base = block * BLOCK_BITS
        found = np.ones(len(keys), dtype=bool)
        for bit in (one, two):
            place = base + bit.astype(np.int64)
            found &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return found


def filter_bits(keys: DataFrame) -> np.ndarray:
    """The filter of a table of keys, as bytes: tasks fill its blocks, 16 MB in all whatever the number of keys."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, one, two = _bits(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.record_batch({"block": block, "one": one, "two": two.astype(np.int64)})

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, dtype=bool)
        for name in ("one", "two"):
            bits[table.column(name).to_numpy()] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([packed], pa.binary())})

    placed = keys.mapInArrow(place, "block long, one long, two long")
    blocks = placed.groupBy("block").applyInArrow(fill, "block long, bits binary").collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    size = BLOCK_BITS // 8
    for row in blocks:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _prepared(docs: DataFrame) -> DataFrame:
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")
    return docs.select(shard.alias("shard"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _written(keys: np.ndarray) -> bytes:
    """Sorted different hashes as the first one and the gaps between them, or as they are where a gap is wide."""
    gaps = np.diff(keys)
    if len(gaps) and gaps.max() < 1 << 32:
        return b"g" + keys[:1].tobytes() + gaps.astype(np.uint32).tobytes()
    return b"k" + keys.tobytes()


def _read(data: bytes) -> np.ndarray:
    if data[:1] == b"k":
        return np.frombuffer(data, np.uint64, offset=1)
    first, gaps = np.frombuffer(data, np.uint64, 1, 1), np.frombuffer(data, np.uint32, offset=9)
    return np.cumsum(np.concatenate((first, gaps.astype(np.uint64))), dtype=np.uint64)


def _packed(keys: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Hashes a task has met, by range: those met once, and those met more often with their counts."""
    unique, n = np.unique(np.concatenate(keys), return_counts=True)
    width = np.uint64(-(-(1 << 48) // parts))
    ends = np.searchsorted(unique, np.arange(parts + 1, dtype=np.uint64) * width)
    rows = []
    for p in np.flatnonzero(np.diff(ends)).tolist():
        key, count = unique[ends[p] : ends[p + 1]], n[ends[p] : ends[p + 1]]
        once = count == 1
        rows.append((p, _written(key[once]), _written(key[~once]), count[~once].astype(np.uint32).tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["part", "once", "often", "counts"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _local_counts(rows: DataFrame, size: int, shorter, support: list[int], parts: int) -> DataFrame:
    """key (shard and phrase hash) and n of the phrases of ``size`` words that reach their shard's support.

    ``shorter`` is the broadcast filter of the level below; only phrases whose two longest parts pass it are
    counted. Hashes travel packed, in ``parts`` parts by hash, each added up by one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if shorter is None else Filter(shorter.value)
        held, total = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part.column("text"), part.column("lang").to_pylist())
                at = words.windows(size)
                if passes is not None:
                    fits = passes(words.keys(at, size - 1))
                    at = at[fits]
                    at = at[passes(words.keys(at + 1, size - 1))]
                shard = part.column("shard").to_numpy(zero_copy_only=False).astype(np.uint64)[words.doc[at]]
                held.append(words.keys(at, size) | shard << np.uint64(KEY_BITS))
                total += len(at)
                if total >= HELD:
                    yield _packed(held, parts)
                    held, total = [], 0
        if total:
            yield _packed(held, parts)

    least = np.array(support, dtype=np.int64)

    def added_up(table: pa.Table) -> pa.Table:
        once, often, counts = (table.column(c).to_pylist() for c in ("once", "often", "counts"))
        keys = np.concatenate([_read(x) for x in (*once, *often)])
        repeats = np.concatenate([np.frombuffer(x, np.uint32) for x in counts]).astype(np.int64)
        n = np.concatenate((np.ones(len(keys) - len(repeats), np.int64), repeats))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n, keys = np.add.reduceat(n, first), keys[first]
        enough = n >= least[(keys >> np.uint64(KEY_BITS)).astype(np.int64)]
        return pa.table({"key": pa.array(keys[enough].view(np.int64)), "n": pa.array(n[enough])})

    packed = rows.mapInArrow(work, "part int, once binary, often binary, counts binary")
    return packed.groupBy("part").applyInArrow(added_up, "key long, n long")


def _mined(rows: DataFrame, longest: int, least: int, scratch: Scratch) -> list:
    """Broadcast filters of the phrases of 1 to ``longest`` words that are frequent in some shard."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = F.shiftrightunsigned("key", KEY_BITS).cast("int")
    words = scratch.save(_local_counts(rows, 1, None, [1] * SHARDS, parts), "words", BATCH)
    in_shard = {r["shard"]: r["n"] for r in words.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n")).collect()}
    everything = sum(in_shard.values())
    # The smallest whole number that is no less than least * share.
    support = [-(-least * in_shard.get(s, 0) // everything) if everything else 1 for s in range(SHARDS)]
    parts = max(parts, everything // PART)
    filters: list = []
    for size in range(1, longest + 1):
        if size == 1:
            frequent = words.where(F.col("n") >= F.element_at(F.array(*map(F.lit, support)), shard + 1))
        else:
            frequent = _local_counts(rows, size, filters[-1], support, parts)
        phrase = F.col("key").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
        with settings(spark, **{ARROW_ROWS: str(BATCH)}):
            bits = filter_bits(frequent.select(phrase.alias("key")))
        filters.append(spark.sparkContext.broadcast(bits))
    scratch.drop("words")
    return filters


def count_phrases(docs: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10) -> DataFrame:
    """lang, size, phrase and n of all phrases of 1 to ``longest`` words that occur ``least`` times in a language.

    A row of size 0 has the number of all words of the language.
    """
    ship(docs.sparkSession)
    rows = _prepared(docs)
    filters = _mined(rows, longest, least, scratch)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [Filter(f.value) for f in filters]
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if sum(h.num_rows for h in held) > COUNTED:
                    held = _added_up(held)
                    if held[0].num_rows > COUNTED // 2:
                        yield from held
                        held = []
                words = Words(part.column("text"), part.column("lang").to_pylist())
                langs = pa.array(words.langs, pa.string())
                every = np.bincount(words.lang, minlength=len(words.langs))
                blank = pa.array([""] * len(langs), pa.string())
                held.append(_rows(langs, 0, blank, every))
                number = words.numbers()
                distinct = int(number.max()) + 1 if len(number) else 0
                for size in range(1, longest + 1):
                    at = words.windows(size)
                    at = at[passes[size - 1](words.keys(at, size))]
                    code = number[at]
                    for k in range(1, size):
                        _, code = np.unique(code, return_inverse=True)
                        code = code * distinct + number[at + k]
                    _, model, n = np.unique(code, return_index=True, return_counts=True)
                    at = at[model]
                    held.append(_rows(langs.take(pa.array(words.lang[at])), size, words.phrases(at, size), n))
        if held:
            yield from _added_up(held)

    counted = rows.mapInArrow(work, "lang string, size int, phrase string, n long")
    summed = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return summed.where((F.col("size") == 0) | (F.col("n") >= least))


def _rows(langs: pa.Array, size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(n), size, dtype=np.int32))
    return pa.record_batch({"lang": langs, "size": sizes, "phrase": phrases, "n": pa.array(n.astype(np.int64))})


def _added_up(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The same counts with one row per language and phrase, as one batch."""
    table = pa.Table.from_batches(rows).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum")])
    table = table.select(["lang", "size", "phrase", "n_sum"]).rename_columns(["lang", "size", "phrase", "n"])
    return table.combine_chunks().to_batches() or [rows[0].slice(0, 0)]


def _part(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    scratch: Scratch,
    longest: int = 3,
    least: int = 10,
    inside_percent: int = 50,
    top: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best ``top`` phrases of 2 to ``longest`` words per language.

    a is how often a phrase occurs, l and r how often the two parts of its worst cut do, n the words of the
    language and score floor(1000000 a a / (l r)). A phrase that lies inside a longer one which occurs at
    least ``inside_percent`` % as often is left out. A null text is empty, a null lang is ``und``; a null doc_id
    only chooses a shard. Ties go to the more frequent phrase, then to code point order. Repeated rows count as
    often as they come; columns other than doc_id, text and lang are not looked at. An empty table, or texts
    without such phrases, give an empty one.
    """
    counts = scratch.save(count_phrases(docs, scratch, longest, least), "phrases", BATCH)
    known = counts.where("size > 0").select("lang", "phrase", F.col("n").cast("decimal(19,0)").alias("f"))
    words = F.split("phrase", " ")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("words"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang",
        "phrase",
        "a",
        "k",
        _part("words", F.lit(1), F.col("k")).alias("left"),
        _part("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (l * r)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    places = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("size") - 1),
                lambda m: F.transform(
                    F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.struct(s.alias("s"), m.alias("m"))
                ),
            )
        )
    )
    longer = candidates.where("size > 2").withColumn("p", places)
    longer = longer.select("lang", _part("words", F.col("p.s"), F.col("p.m")).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", "n")
    return best.join(total, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        F.col("cut.l").cast("long").alias("l"),
        F.col("cut.r").cast("long").alias("r"),
        "n",
        F.col("cut.score").alias("score"),
    )
