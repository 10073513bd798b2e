"""Packing against plain encoding, a plain BM25 and the rules of sequences."""

import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import packing
from pageloom.llm.queries import QUERIES
from pageloom.llm.storage import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(VOCABULARY)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, encoding="utf-8") as file:
        return packing.Encoder(file.read())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_sequences(pieces, documents, window=1024):
    """Every id in one piece, sequences without gaps, padding only where a length is no power of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(documents)
    for doc_id, mine in by_doc.items():
        at, ids = 0, documents[doc_id]
        for p in sorted(mine, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            raw = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(raw)
            at += p["length"]
        assert at == len(ids)
    lengths = Counter()
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or (at < window and at & (at - 1) == 0)
        lengths[at] += 1
    return lengths


def test_query_against_plain_encoding(spark, tokenizer):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    pieces = [r.asDict() for r in QUERIES["op13_lexical_packing"](spark, SF).collect()]
    lengths = check_sequences(pieces, {k: plain_ids(tokenizer, t) for k, t in rows})
    assert lengths[1024] > 0.9 * sum(lengths.values())


ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "\n\t  \x1c x\x85 y  z　"),
    (5, "<|endoftext|> is <|endoftext|>text"),
    (6, " 'tis we'll 's  're  'd 漢字🙂 é​ é"),
    (7, "acgt" * 50_000),
    (8, "word " * 30_000),
    (9, " " * 5000 + "x" + "\n" * 5000),
    (10, "\x00\x01 ﻿ a‍ b᠎ c"),
]


def test_odd_texts(spark, tokenizer):
    """Null, empty and very long texts, white space of all kinds, strings of special tokens, clashing names."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("z") for c in ("shard", "start", "token", "ids", "n")})
    got = packing.pack(docs, Scratch(spark, "t"), VOCABULARY).withColumn("ids_crc32", F.crc32("ids"))
    check_sequences([r.asDict() for r in got.collect()], {k: plain_ids(tokenizer, t) for k, t in ODD})


def test_repeated_rows_null_ids_and_no_rows(spark, tokenizer):
    rows = [(None, "same text"), (None, "same text"), (5, "same text"), (5, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, Scratch(spark, "t"), VOCABULARY).collect()
    n = len(plain_ids(tokenizer, "same text"))
    assert Counter({k: sum(r.length for r in got if r.doc_id == k) for k in (None, 5)}) == {None: 2 * n, 5: 2 * n}
    assert packing.pack(docs.limit(0), Scratch(spark, "t"), VOCABULARY).collect() == []


def test_both_libraries_give_the_same_ids(tokenizer, encoder):
    assert encoder.fast
    rng = random.Random(4)
    parts = ["a", "ä", "the", "漢", "🙂", "1", "'s", "'", ".", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1f", "\x85", "\u0301", "\u200b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_files_whose_merges_are_not_in_order_are_not_read_as_ranks():
    with open(VOCABULARY, encoding="utf-8") as file:
        rules = json.load(file)
    assert packing.ranks_of(json.dumps(rules)) is not None
    swapped = json.loads(json.dumps(rules))
    swapped["model"]["merges"][5:7] = reversed(swapped["model"]["merges"][5:7])
    lower = rules | {"normalizer": {"type": "Lowercase"}}
    assert packing.ranks_of(json.dumps(swapped)) is None and packing.ranks_of(json.dumps(lower)) is None


def test_index_against_plain_bm25():
    rng = np.random.default_rng(1)
    units = [rng.integers(0, 30, rng.integers(0, 40)).astype("<u2") for _ in range(50)]
    idf, mean = rng.random(30) + 0.1, 17.0
    index = packing.Index(units, idf, mean)
    for seed in range(50):
        scores = []
        for u in units:
            tf = Counter(u.tolist())
            norm = packing.K1 * (1 - packing.B + packing.B * len(u) / mean)
            scores.append(sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(units[seed].tolist()) if tf[t]))
        found = [scores[k] for k in index.neighbours(seed)]
        assert all(a >= b or math.isclose(a, b) for a, b in zip(found, found[1:], strict=False))


def test_neighbours_read_alike():
    """Documents of two vocabularies do not meet in a window while their own kind is left."""
    rng = np.random.default_rng(2)
    units = [rng.integers(100 * (k % 2), 100 * (k % 2) + 100, 300).astype("<u2") for k in range(60)]
    idf = np.ones(200)
    sequences = packing.fill(units, packing.Index(units, idf, 300.0), 1024)
    mixed = sum(len({u % 2 for u, _, _ in s}) > 1 for s in sequences)
    assert mixed <= 2


def test_remainder_is_cut_into_powers_of_two():
    sequences = list(packing._powers([(0, 5, 300), (1, 0, 400)]))
    assert [sum(n for _, _, n in s) for s in sequences] == [512, 128, 32, 16, 8, 4]
    assert sequences[0] == [(0, 5, 300), (1, 0, 212)] and sequences[1] == [(1, 212, 128)]


def test_another_kind_of_file_is_read_by_its_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["Two  words", None, "", "é 漢字"]
    assert encoder.fast is None
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids
