"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model reads words as characters: n-grams of ``ORDER`` characters inside a word with its begin and end.
Counts, continuation counts, discounts and back-off weights are tables, joined by n-gram and by context.

Scoring joins counts to shards of documents, never n-grams to single documents: a task packs its texts into
shards of at most some tens of MB and lists each shard's distinct n-grams in sorted, compressed blocks, cut by a hash.
The blocks of a hash meet in one group, which names each n-gram once; the named ones meet the tables and get their
log probability, and a block's answers go back to its shard in the block's order, without the n-grams. Texts
are written once, bucketed by shard, and read back without a shuffle, for training (the shard learns which of its
documents are trusted) as for scoring. What is shuffled grows with the shards and is a small part of the texts.

Documents of trusted text in the held-out fold are not trained on; the quantiles of their perplexity, by
language, are the thresholds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch
from pageloom.llm.textops import mix, slices, span_hashes, text_bytes, word_spans

ORDER = 5
FOLDS = 5
SHARD_BYTES = 32 << 20
BUCKETS = 48
# Blocks of n-grams are dealt to so many groups, or to as many as the session shuffles to, if that is more.
PARTS = 64
# Share of held-out trusted texts that the threshold lets pass, and what is added for chance.
QUANTILE = 0.99
SLACK = 1.1
# A language with fewer held-out trusted texts takes the threshold of all.
LEAST = 30
BEGIN, END = "\x02", "\x03"
BLOCKS = pa.list_(pa.struct([("part", pa.int32()), ("grams", pa.binary())]))
SHARDS_AT_ONCE = 1


def word_grams(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all n-grams of the words (one row each) and how many each word has."""
    data = raw.tobytes()
    joined = (BEGIN * (ORDER - 1) + (END + BEGIN * (ORDER - 1)).join(
        data[a:b].decode("utf-8", "replace") for a, b in zip(first, last, strict=True)
    ) + END) if len(first) else ""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty((0, ORDER), np.uint32), np.empty(0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    # An n-gram ends at a character of the word or at its end, not in the padding.
    inner = grams[:, -1] != 2
    bounds = np.flatnonzero(points == 3)
    ends = np.flatnonzero(inner) + ORDER - 1
    # A word may hold the control characters itself; the padding tells the true ends.
    true = bounds[(bounds + 1 == len(points)) | (points[np.minimum(bounds + 1, len(points) - 1)] == 2)]
    counts = np.diff(np.concatenate(([0], np.searchsorted(ends, true, side="right"))))
    return grams[inner], counts.astype(np.int64)


def gram_keys(grams: np.ndarray) -> np.ndarray:
    key = np.zeros(len(grams), dtype=np.uint64)
    for k in range(ORDER):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + grams[:, k])
    return key


def gram_blocks(grams: np.ndarray, keys: np.ndarray, parts: int) -> list[dict]:
    """The n-grams cut by key; a block is sorted and keeps its code points column by column, compressed."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((*(grams[:, k] for k in reversed(range(ORDER))), part))
    part, grams = part[order], grams[order]
    squeeze = zstandard.ZstdCompressor(level=3)
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    return [
        {"part": int(part[a]), "grams": squeeze.compress(np.ascontiguousarray(grams[a:b].T).tobytes())}
        for a, b in pairwise(cuts)
    ]


def block_grams(block: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(block)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint32).reshape(ORDER, -1).T)


def gram_strings(grams: np.ndarray) -> list[str]:
    text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le")
    return [text[k : k + ORDER] for k in range(0, len(text), ORDER)]


def _unpacked(packed: pa.Scalar) -> Iterator[pa.RecordBatch]:
    """The rows of a shard."""
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed.as_buffer())) as stream:
        yield from stream


def _clean(texts: Column) -> Column:
    """Without the two control characters that mark begin and end of words."""
    return F.translate(texts, BEGIN + END, "\x1a\x1a")


def trusted_words(shards: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """Words of the texts of ``trusted(doc_id)`` and their counts, combined in the task first.

    Only numbers of documents are shuffled: each shard learns which of its own are trusted.
    """
    held = shards.select("shard", F.explode("ids").alias("doc_id"))
    marks = held.join(trusted.select("doc_id"), "doc_id", "left_semi")
    # Written first: Spark would keep an aggregate's partitions, if they are more, and shuffle the shards to them.
    marks = scratch.save(marks.groupBy("shard").agg(F.collect_set("doc_id").alias("marked")), "marks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, marked in zip(batch.column("packed"), batch.column("marked"), strict=True):
                for part in _unpacked(packed):
                    texts = part.column("text").filter(pc.is_in(part.column("doc_id"), marked.values))
                    raw, offs = text_bytes(texts)
                    first, last, _ = word_spans(raw, offs)
                    _, index, counts = np.unique(span_hashes(raw, first, last), return_index=True, return_counts=True)
                    data = raw.tobytes()
                    spans = zip(first[index], last[index], strict=True)
                    words = [data[a:b].decode("utf-8", "replace") for a, b in spans]
                    yield pa.record_batch({"word": pa.array(words, pa.string()), "n": counts.astype(np.int64)})

    found = shards.join(marks, "shard").select("packed", "marked").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    row = counts.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(row[f"n{k}"]) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return max(0.05, min(d1, 0.95)), max(0.05, min(d2, 1.95)), max(0.05, min(d3, 2.95))


def train(words: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], float]:
    """Probabilities by n-gram and weights by context for orders 1 to ``ORDER``, and the base probability."""
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), "word", F.lit(END))
    places = F.sequence(F.lit(1), F.length("word") + 1)
    grams = words.select("n", F.explode(F.transform(places, lambda k: F.substring(padded, k, F.lit(ORDER)))).alias("gram"))
    counts = {ORDER: scratch.save(grams.groupBy("gram").agg(F.sum("n").alias("n")), f"count-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct n-grams one longer with this end
        ends = counts[k + 1].select(F.substring("gram", 2, k).alias("gram"))
        counts[k] = scratch.save(ends.groupBy("gram").agg(F.count("*").alias("n")), f"count-{k}")
    base = 1.0 / (counts[1].count() + 1)
    probs, weights = [], []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[k])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, k - 1)
        rows = counts[k].select("gram", "n", context.alias("context"), F.least(off, F.col("n")).alias("off"))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("spare"))
        weight = scratch.save(sums.select("context", "total", (F.col("spare") / F.col("total")).alias("weight")), f"weight-{k}")
        joined = rows.join(weight, "context")
        if k == 1:
            lower = F.lit(base)
        else:
            shorter = probs[-1].select(F.col("gram").alias("end"), F.col("p").alias("lower"))
            joined = joined.join(shorter, F.substring("gram", 2, k - 1) == F.col("end"))
            lower = F.col("lower")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * lower
        probs.append(scratch.save(joined.select("gram", p.alias("p")), f"prob-{k}"))
        weights.append(weight.select("context", "weight"))
    return probs, weights, base


def log_probabilities(grams: DataFrame, model: tuple[list[DataFrame], list[DataFrame], float]) -> DataFrame:
    """The rows of distinct n-grams of full order (``gram``), seen or not, with ``lp``.

    p = p_k of the longest end that was seen, times the weights of the contexts it was not seen after.
    """
    probs, weights, base = model
    rows = grams
    for k in range(1, ORDER + 1):
        end = F.substring("gram", ORDER - k + 1, k)
        seen = probs[k - 1].select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}"))
        rows = rows.withColumn(f"e{k}", end).join(seen, F.col(f"e{k}") == F.col(f"g{k}"), "left")
        after = weights[k - 1].select(F.col("context").alias(f"c{k}"), F.col("weight").alias(f"w{k}"))
        rows = rows.join(after, F.substring(f"e{k}", 1, k - 1) == F.col(f"c{k}"), "left").drop(f"g{k}", f"c{k}", f"e{k}")
    p = F.lit(base)
    for k in range(1, ORDER + 1):
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"w{k}"), F.lit(1.0)) * p)
    return rows.select(*grams.columns, F.log(p).alias("lp"))


def pack(docs: DataFrame, parts: int) -> DataFrame:
    """Shards of documents: number, doc_ids, blocks of distinct n-grams, and the rows themselves, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, size, number
            seen = np.empty(0, np.uint64)
            grams = np.empty((0, ORDER), np.uint32)
            words = np.empty(0, np.uint64)
            for part in held:
                raw, offs = text_bytes(part.column("text"))
                first, last, _ = word_spans(raw, offs)
                keys, index = np.unique(span_hashes(raw, first, last), return_index=True)
                fresh = ~np.isin(keys, words, assume_unique=True)
                words = np.union1d(words, keys)
                own, _ = word_grams(raw, first[index[fresh]], last[index[fresh]])
                key = gram_keys(own)
                key, index = np.unique(key, return_index=True)
                fresh = ~np.isin(key, seen, assume_unique=True)
                seen, grams = np.concatenate((seen, key[fresh])), np.concatenate((grams, own[index[fresh]]))
            ids = pa.chunked_array([part.column("doc_id") for part in held], pa.int64()).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            out = pa.record_batch(
                {
                    "shard": pa.array([(task << 24) + number], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    "grams": pa.array([gram_blocks(grams, seen, parts)], BLOCKS),
                    "packed": pa.array([squeeze.compress(sink.getvalue())], pa.binary()),
                }
            )
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(part)
                size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if size >= SHARD_BYTES:
                    yield shard()
        if held:
            yield shard()

    return docs.mapInArrow(
        work, "shard long, ids array<long>, grams array<struct<part: int, grams: binary>>, packed binary"
    )


def asked_grams(blocks: DataFrame) -> DataFrame:
    """part and gram, once each, of all n-grams of the blocks."""

    def work(asked: pa.Table) -> pa.Table:
        seen, grams = np.empty(0, np.uint64), np.empty((0, ORDER), np.uint32)
        for block in asked.column("grams"):
            own = block_grams(block.as_py())
            key, index = np.unique(gram_keys(own), return_index=True)
            fresh = ~np.isin(key, seen, assume_unique=True)
            seen, grams = np.concatenate((seen, key[fresh])), np.concatenate((grams, own[index[fresh]]))
        part = np.full(len(grams), asked.column("part")[0].as_py(), np.int32)
        return pa.table({"part": part, "gram": pa.array(gram_strings(grams), pa.string())})

    return blocks.groupBy("part").applyInArrow(work, "part int, gram string")


def answered(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """shard, part and the log probabilities of a block's n-grams, in its order, as bytes."""

    def work(asked: pa.Table, known: pa.Table) -> pa.Table:
        text = "".join(known.column("gram").to_pylist())
        keys = gram_keys(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, ORDER))
        order = np.argsort(keys)
        keys, lp = keys[order], known.column("lp").to_numpy()[order]
        found = [
            lp[np.searchsorted(keys, gram_keys(block_grams(b.as_py())))].tobytes() for b in asked.column("grams")
        ]
        return pa.table(
            {"shard": asked.column("shard"), "part": asked.column("part"), "lps": pa.array(found, pa.binary())}
        )

    return blocks.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(work, "shard long, part int, lps binary")


def perplexities(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, lang and perplexity per character of each document of the shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, grams, lps in zip(*(batch.column(c) for c in ("packed", "grams", "lps")), strict=True):
                found = {x["part"]: x["lps"] for x in lps.as_py() or ()}
                keys = [np.empty(0, np.uint64)] + [gram_keys(block_grams(x["grams"])) for x in grams.as_py()]
                values = [np.empty(0)] + [np.frombuffer(found[x["part"]]) for x in grams.as_py()]
                keys, lp = np.concatenate(keys), np.concatenate(values)
                order = np.argsort(keys)
                for part in _unpacked(packed):
                    yield _scored(part, keys[order], lp[order])

    return shards.join(answers, "shard", "left").select("packed", "grams", "lps").mapInArrow(
        work, "doc_id long, lang string, n_words long, perplexity double"
    )


def _scored(part: pa.RecordBatch, keys: np.ndarray, lp: np.ndarray) -> pa.RecordBatch:
    raw, offs = text_bytes(part.column("text"))
    n = len(offs) - 1
    first, last, doc = word_spans(raw, offs)
    _, index, inverse = np.unique(span_hashes(raw, first, last), return_index=True, return_inverse=True)
    grams, counts = word_grams(raw, first[index], last[index])
    total, length = np.zeros(n), np.zeros(n)
    if len(grams):
        values = lp[np.searchsorted(keys, gram_keys(grams))]
        own = np.add.reduceat(values, np.cumsum(counts) - counts)
        total = np.bincount(doc, own[inverse], minlength=n)
        length = np.bincount(doc, counts[inverse], minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.exp(-total / length)
    return pa.record_batch(
        {
            "doc_id": part.column("doc_id"),
            "lang": part.column("lang"),
            "n_words": np.bincount(doc, minlength=n).astype(np.int64),
            "perplexity": pa.array(score, pa.float64(), mask=length == 0),
        }
    )


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row of ``docs(doc_id, text, lang)``.

    Trusted texts are those labelled quality 1. kept: perplexity at most the threshold of the language. A
    text without words has no perplexity and is not kept; without any trusted text everything else is kept.
    Rows without doc_id are scored, never trained on; a null lang is a language of its own. Repeated rows are
    repeated; other columns are not looked at; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), _clean(F.col("text")).alias("text"), "lang")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    # Written first, so that its size is known and Spark decides between broadcast and shuffle on it.
    trusted = scratch.save(good.select("doc_id", fold.alias("fold")), "trusted")
    parts = max(PARTS, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"shards_{uuid.uuid4().hex}"
    writer = pack(rows, parts).write.format("parquet").bucketBy(BUCKETS, "shard").option("path", scratch.path("shards"))
    writer.saveAsTable(name)
    shards = scratch.spark.table(name)
    # A row holds a whole shard, so few of them go to a Python worker at once.
    words = scratch.save(trusted_words(shards, trusted.where("fold <> 0"), scratch), "words", batch=SHARDS_AT_ONCE)
    model = train(words, scratch)
    blocks = shards.select("shard", F.explode("grams").alias("b")).select("shard", "b.part", "b.grams")
    asked = scratch.save(asked_grams(blocks), "asked")
    known = scratch.save(log_probabilities(asked, model), "known")
    model_tables = (f"{kind}-{k}" for kind in ("count", "weight", "prob") for k in range(1, ORDER + 1))
    scratch.drop("words", "marks", "asked", *model_tables)
    answers = answered(blocks, known).groupBy("shard").agg(F.collect_list(F.struct("part", "lps")).alias("lps"))
    answers = scratch.save(answers, "answers")
    found = perplexities(shards.select("shard", "grams", "packed"), answers)
    scored = scratch.save(found, "scored", batch=SHARDS_AT_ONCE)
    scratch.spark.sql(f"DROP TABLE {name}")  # external: its files go here
    scratch.drop("shards", "known", "answers")

    apart = scored.join(trusted.where("fold = 0"), "doc_id", "left_semi").where("perplexity is not null")
    own = apart.groupBy("lang").agg(
        F.count("*").alias("n"), F.percentile_approx("perplexity", QUANTILE, 10_000).alias("q")
    )
    every = apart.agg(F.percentile_approx("perplexity", QUANTILE, 10_000)).first()[0]
    every = F.lit(every).cast("double")
    limits = own.select(F.col("lang").alias("l"), F.when(F.col("n") >= LEAST, F.col("q")).otherwise(every).alias("q"))
    limits = scratch.save(limits, "limits")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("q", every) * SLACK
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
