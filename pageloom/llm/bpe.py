"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark partitions.

Spark deals out the texts; each task splits its texts into words with array passes and asks an in-process
DuckDB for the words it has not met. There, words are rows (word, position, token, next token). One step of
the recursive query joins the pairs with the merge table, finds each word's leftmost pair of minimum rank
and contracts it; words without such a pair leave the recursion. The fixpoint, in order of position, is the
word's ids. Decoding joins ids with the vocabulary and aggregates the pieces in order.

A worker remembers words it has encoded, up to ``MEMO`` of them, so a frequent word is contracted once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.shipping import ship
from pageloom.llm.textops import ragged, slices, span_hashes, text_bytes

# Words a worker remembers, and words in one recursive query.
MEMO = 500_000
WORDS = 10_000
SLICE = 1 << 20
# A recursion keeps all its steps, so it takes words of up to so many bytes; the steps of a longer word replace
# one another in a table of live rows.
LONG = 256
# Bytes of long words in one table, unless a single one has more.
LIVE_BYTES = 500_000
# Bits of a position in the recursion.
BITS = 9

# The endings that the pattern of these vocabularies splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3

ENCODE = f"""
WITH RECURSIVE step(w, pos, tok, nxt, ntok, it) AS (
  SELECT w, pos, tok, pos + 1, lead(tok) OVER (PARTITION BY w ORDER BY pos), 0 FROM word_rows
  UNION ALL (
    WITH best AS (
      SELECT w, min((rank << {2 * BITS}) + (pos << {BITS}) + nxt) AS b
      FROM step JOIN merges ON pair = tok * 65536 + ntok GROUP BY w
    ), pick AS (
      SELECT best.w, b >> {2 * BITS} AS made, (b >> {BITS}) & {2**BITS - 1} AS p, b & {2**BITS - 1} AS q,
             gone.nxt AS qn, gone.ntok AS qt
      FROM best JOIN step gone ON gone.w = best.w AND gone.pos = (b & {2**BITS - 1})
    )
    SELECT step.w, pos, CASE WHEN pos = p THEN made ELSE tok END, CASE WHEN pos = p THEN qn ELSE nxt END,
           CASE WHEN pos = p THEN qt WHEN nxt = p THEN made ELSE ntok END, it + 1
    FROM step JOIN pick USING (w) WHERE pos <> q
  )
), fix AS (SELECT step.w, pos, tok FROM step JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it))
SELECT w, list(tok ORDER BY pos)::INT[] AS ids, string_agg(hex(piece), '' ORDER BY pos) AS text
FROM fix JOIN pieces ON pieces.id = fix.tok GROUP BY w ORDER BY w
"""

# One step of long words: every word contracts the occurrences of its pair of minimum rank. Occurrences that
# overlap are taken from the left. Where a new pair would have a smaller rank still, only the leftmost is taken,
# as that pair would come before the others.
PLACE = """
CREATE OR REPLACE TABLE live AS
SELECT w, pos, tok, nxt, ntok, rank FROM (
  SELECT w, pos, tok, pos + 1 AS nxt, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS ntok FROM word_rows
) LEFT JOIN merges ON pair = tok * 65536 + ntok
"""
PICK = """
CREATE OR REPLACE TABLE hit AS
WITH best AS (SELECT w, min(rank) AS made FROM live GROUP BY w HAVING min(rank) IS NOT NULL),
found AS (SELECT live.w, pos, nxt, made FROM live JOIN best ON live.w = best.w AND rank = made),
marked AS (SELECT *, lag(nxt) OVER (PARTITION BY w ORDER BY pos) IS DISTINCT FROM pos AS starts FROM found),
runs AS (SELECT *, sum(starts::INT) OVER (PARTITION BY w ORDER BY pos) AS run FROM marked),
odd AS (SELECT w, pos, nxt, made FROM (
  SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 AS odd FROM runs) WHERE odd = 1),
ends AS (SELECT odd.w, odd.pos, odd.nxt, made, gone.nxt AS qn, gone.ntok AS qt FROM odd JOIN live gone
  ON gone.w = odd.w AND gone.pos = odd.nxt),
around AS (SELECT ends.*, before.tok AS pt FROM ends LEFT JOIN live before ON before.w = ends.w AND before.nxt = ends.pos),
sooner AS (SELECT DISTINCT w FROM around JOIN merges ON pair IN (made * 65536 + qt, pt * 65536 + made, made * 65536 + made)
  WHERE rank < made)
SELECT w, pos, nxt, made, qn, qt FROM around
WHERE w NOT IN (SELECT w FROM sooner) OR pos = (SELECT min(o.pos) FROM odd o WHERE o.w = around.w)
"""
CONTRACT = """
CREATE OR REPLACE TABLE live AS
WITH kept AS (SELECT live.*, hit.made, hit.qn, hit.qt FROM live LEFT JOIN hit ON hit.w = live.w AND hit.pos = live.pos
  WHERE NOT EXISTS (SELECT 1 FROM hit gone WHERE gone.w = live.w AND gone.nxt = live.pos)),
moved AS (SELECT w, pos, coalesce(made, tok) AS tok, CASE WHEN made IS NULL THEN nxt ELSE qn END AS nxt,
  CASE WHEN made IS NULL THEN ntok ELSE qt END AS ntok, rank, made IS NOT NULL AS own FROM kept),
met AS (SELECT moved.w, moved.pos, moved.tok, moved.nxt, coalesce(hit.made, moved.ntok) AS ntok, rank,
  own OR hit.made IS NOT NULL AS fresh FROM moved LEFT JOIN hit ON hit.w = moved.w AND hit.pos = moved.nxt)
SELECT w, pos, tok, nxt, ntok, rank FROM met WHERE NOT fresh
UNION ALL
SELECT w, pos, tok, nxt, ntok, merges.rank FROM met LEFT JOIN merges ON pair = tok * 65536 + ntok WHERE fresh
"""
LIVE = """
SELECT w, list(tok ORDER BY pos)::INT[] AS ids, string_agg(hex(piece), '' ORDER BY pos) AS text
FROM live JOIN pieces ON pieces.id = live.tok GROUP BY w ORDER BY w
"""

DECODE = """
SELECT w, string_agg(hex(piece), '' ORDER BY pos) AS text
FROM id_rows JOIN pieces USING (id) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line. Vocabularies have a fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for match in regex.finditer(pattern, every):
            a, b = match.span()
            move = 0x800
            for lo, hi in ((a, min(b, 0xD800)), (max(a, 0xD800) + move, b + move)):
                kinds[lo:hi] = kind
    return kinds


def split_words(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, for code points of texts that begin at ``text_start``.

    The matches cover everything, so starts are enough. They follow from runs of one class: a run of
    letters, numbers or other signs is a match, with a blank before it; of a white space run the last
    character stands alone unless it is that blank; an apostrophe that is a run of its own takes an ending.
    """
    n = len(points)
    kind = char_classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_start] = True
    edge[n] = True
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    white = kind == WHITE
    # The last white space before a word begins a match, which a blank shares with the word.
    last = np.zeros(n, dtype=bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    start |= last
    blank = np.flatnonzero(last & (points == 0x20))
    start[blank + 1] = False
    # An apostrophe as a whole run at the begin of a match, then a letter.
    mark = np.flatnonzero((points[:-1] == 0x27) & run[:-1] & start[:-1] & run[1:] & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(mark):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = padded[mark + 1], padded[mark + 2]
        inside = np.zeros(len(mark), dtype=bool)
        near = mark + 2 < n
        inside[near] = ~run[mark[near] + 2]
        took = np.zeros(len(mark), dtype=np.int64)
        for ending in ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) == 2:
                fits &= inside & (two == ord(ending[1]))
            took[fits] = len(ending)
        mark, took = mark[took > 0], took[took > 0]
        start[mark + 1] = False
        after = mark + 1 + took
        after = after[after < n]
        start[after] = True
        # A blank right after the ending shares its match with the word behind it, as before.
    return np.flatnonzero(start)


class Encoder:
    """Words to ids, by DuckDB, remembered as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._con: duckdb.DuckDBPyConnection | None = None
        splits = [
            (left * 65536 + right, rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        ]
        pair, rank = zip(*splits, strict=True) if splits else ((), ())
        self.fixed = {
            "merges": pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int64())}),
            "pieces": pa.table({"id": pa.array(ranks.values(), pa.int64()), "piece": pa.array(ranks, pa.binary())}),
        }
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        whole = list(ranks)
        raw = np.frombuffer(b"".join(whole), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in whole])
        starts = ends - [len(t) for t in whole]
        self.base = (span_hashes(raw, starts, ends), np.array([ranks[t] for t in whole], np.int32), starts, ends, raw)
        self._forget()

    @property
    def con(self) -> duckdb.DuckDBPyConnection:
        """The worker's own database in memory, with the vocabulary in it."""
        if self._con is None:
            self._con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
            for name, rows in self.fixed.items():
                self._table(name, rows)
        return self._con

    def rest(self) -> None:
        """Close the database at the end of a task: it keeps the memory of its largest query, ten times what is
        remembered here, while the worker goes on to other steps. The next word not yet met opens it again."""
        if self._con is not None:
            self._con.close()
            self._con = None
        pa.default_memory_pool().release_unused()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)
        self.text = np.empty(0, np.uint8)
        self.begin = np.zeros((0, 4), np.int64)  # ids from, count, text from, count
        # A word that is in the vocabulary is its own id.
        keys, ids, starts, ends, raw = self.base
        own = np.arange(len(ids), dtype=np.int64)
        self._remember(keys, ids, raw, np.stack([own, np.ones_like(own), starts, ends - starts], axis=1))

    def _remember(self, keys: np.ndarray, ids: np.ndarray, text: np.ndarray, spans: np.ndarray) -> None:
        spans = spans + np.array([len(self.ids), 0, len(self.text), 0])
        row = len(self.begin) + np.arange(len(keys))
        order = np.argsort(keys, kind="stable")
        place = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, place, keys[order])
        self.at = np.insert(self.at, place, row[order])
        self.ids = np.concatenate((self.ids, ids))
        self.text = np.concatenate((self.text, text))
        self.begin = np.concatenate((self.begin, spans))

    def _contract(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray) -> None:
        """Encode the words at these spans and remember them."""
        long = last - first > LONG
        # Long words take their steps together, so many of them cost about what the longest does.
        groups = np.cumsum((last - first)[long]) // LIVE_BYTES
        for group in np.unique(groups):
            some = np.flatnonzero(long)[groups == group]
            self._contract_some(raw, first[some], last[some], keys[some], self._fixpoint)
        first, last, keys = first[~long], last[~long], keys[~long]
        for k in range(0, len(first), WORDS):
            part = slice(k, k + WORDS)
            self._contract_some(raw, first[part], last[part], keys[part], lambda: self.con.execute(ENCODE).fetchnumpy())

    def _fixpoint(self) -> dict:
        """The words of ``word_rows`` contracted step by step in a table."""
        self.con.execute(PLACE)
        while self.con.execute(PICK).fetchone() and self.con.execute("SELECT count(*) FROM hit").fetchone()[0]:
            self.con.execute(CONTRACT)
        return self.con.execute(LIVE).fetchnumpy()

    def _contract_some(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray, contract) -> None:
        if len(a):
            lens = b - a
            place = ragged(np.zeros(len(a), np.int64), lens)
            rows = {
                "w": pa.array(np.repeat(np.arange(len(a), dtype=np.int64), lens)),
                "pos": pa.array(place),
                "tok": pa.array(self.byte_ids[raw[ragged(a, lens)]]),
            }
            self._table("word_rows", pa.table(rows))
            found = contract()
            counts = np.array([len(x) for x in found["ids"]], dtype=np.int64)
            pool = np.concatenate(found["ids"]).astype(np.int32)
            joined = bytes.fromhex("".join(found["text"]))
            sizes = np.array([len(t) // 2 for t in found["text"]], dtype=np.int64)
            spans = np.stack([np.cumsum(counts) - counts, counts, np.cumsum(sizes) - sizes, sizes], axis=1)
            self._remember(keys, pool, np.frombuffer(joined, dtype=np.uint8), spans)

    def rows_of(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Row of each word in the memo, after what was missing has been encoded."""
        if len(self.keys) > MEMO:
            self._forget()
        keys = span_hashes(raw, first, last)
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
        new = self.keys[place] != unique
        if new.any():
            self._contract(raw, first[index[new]], last[index[new]], unique[new])
            place = np.searchsorted(self.keys, unique)
        return self.at[place][inverse]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and decoded bytes of each text: values and where each text's begin, twice."""
        n = len(offs) - 1
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64), np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        byte = np.concatenate(([0], np.cumsum(width)))
        text_start = np.searchsorted(byte, offs[:-1][offs[:-1] < len(raw)])
        words = byte[split_words(points, text_start)]
        first, last = words, np.append(words[1:], len(raw))
        rows = self.rows_of(raw, first, last)
        spans = self.begin[rows]
        doc = np.searchsorted(words, offs)  # words before each text's begin
        out = []
        for pool, at in ((self.ids, 0), (self.text, 2)):
            ends = np.concatenate(([0], np.cumsum(spans[:, at + 1])))
            out += [pool[ragged(spans[:, at], spans[:, at + 1])], ends[doc]]
        return tuple(out)

    def decode(self, lists: list[list[int]]) -> list[bytes]:
        """Bytes of lists of ids; an id outside the vocabulary has none."""
        rows = {
            "w": np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
            "pos": np.concatenate([np.arange(len(x)) for x in lists]) if lists else [],
            "id": np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else [],
        }
        self._table("id_rows", pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()}))
        found = dict(self.con.execute(DECODE).fetchall())
        return [bytes.fromhex(found.get(k, "")) for k in range(len(lists))]


_encoders: dict[int, Encoder] = {}


@contextmanager
def _encoder(shared) -> Iterator[Encoder]:
    """The worker's encoder for a task: tasks of one worker share what it remembers, not its database."""
    if shared.key not in _encoders:
        _encoders.clear()
        _encoders[shared.key] = Encoder(shared.ranks.value)
    try:
        yield _encoders[shared.key]
    finally:
        _encoders[shared.key].rest()


class _Shared:
    """The broadcast vocabulary and a key for it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        ship(spark)
        ranks = read_ranks(path)
        self.key = hashlib.sha1(repr(sorted(ranks.items())[:1000]).encode() + str(len(ranks)).encode()).hexdigest()
        self.ranks = spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, vocabulary: str, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> in ``column``; null texts have no ids.

    Ids are those of the rank file at ``vocabulary`` without special tokens. Other columns stay as they are;
    one of the new name is replaced. Repeated rows and empty tables are nothing special.
    """
    shared = _Shared(docs.sparkSession, vocabulary)
    docs = docs.drop(column)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(shared) as encoder:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    ids, begin, _, _ = encoder.encode(*text_bytes(part.column("text")))
                    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))
                    yield pa.record_batch([*part.columns, lists], names=[*names, column])

    fields = docs.withColumn(column, F.array(F.lit(1))).schema
    return docs.mapInArrow(work, fields)


def decode(rows: DataFrame, vocabulary: str, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of the ids in ``column``; null ids have none."""
    shared = _Shared(rows.sparkSession, vocabulary)
    rows = rows.drop("decoded")
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(shared) as encoder:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    texts = encoder.decode([x or [] for x in part.column(column).to_pylist()])
                    yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    return rows.mapInArrow(work, rows.withColumn("decoded", F.lit(b"")).schema)


def round_trip(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass.

    The columns of ``keep`` go along, and the ids as array<int> where asked for. Ids are hashed as
    little-endian unsigned 32-bit integers. A null text is encoded as an empty one.
    """
    shared = _Shared(docs.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(shared) as encoder:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    found, begin, text, where = encoder.encode(*text_bytes(part.column("text")))
                    raw, text = found.astype("<u4"), text.tobytes()
                    pairs = list(zip(begin[:-1], begin[1:], where[:-1], where[1:], strict=True))
                    out = {c: part.column(c) for c in keep}
                    out["n_tokens"] = pa.array(np.diff(begin))
                    out["ids_sha256"] = pa.array(
                        [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b, _, _ in pairs], pa.string()
                    )
                    out["decoded_sha256"] = pa.array(
                        [hashlib.sha256(text[c:d]).hexdigest() for _, _, c, d in pairs], pa.string()
                    )
                    if ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(found))
                    yield pa.record_batch(out)
                pa.default_memory_pool().release_unused()

    rows = docs.select(*keep, "text")
    schema = rows.select(
        *keep,
        F.lit(0).cast("long").alias("n_tokens"),
        F.lit("").alias("ids_sha256"),
        F.lit("").alias("decoded_sha256"),
        *([F.array(F.lit(0)).alias("ids")] if ids else []),
    ).schema
    return rows.mapInArrow(work, schema)
