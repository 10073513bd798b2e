"""Word spans and hashes of a column of texts, computed on its bytes at once.

These helpers run inside tasks: an Arrow column in, numpy arrays out. No Python object is made for a
word, so millions of words cost array passes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A batch is worked off in slices of about so many bytes, which bounds the arrays of a task.
SLICE_BYTES = 4 << 20

# The white space of all contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)  # 5 modulo 8: its powers repeat late


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``most`` bytes of text, or of one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text begins (one entry more than texts)."""
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, in order."""
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offs] = True
    inside = ~SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(offs, first, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span that does not overlap the one before; ``lower`` folds A-Z."""
    lens = last - first
    full = lens > 0
    out = np.zeros(len(first), dtype=np.uint64)
    if full.any():
        some = lens[full]
        begin = np.cumsum(some) - some
        place = np.arange(int(some.sum()), dtype=np.int64) - np.repeat(begin, some)
        powers = np.full(int(some.max()) + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        values = (_LOWER if lower else _BYTE)[raw[np.repeat(first[full], some) + place]] * powers[place]
        out[full] = np.add.reduceat(values, begin)
    return mix(out ^ (lens.astype(np.uint64) << np.uint64(40)))


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``size`` words within one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0xD1342543DE82EF95) + words[at + k])
    return value, at


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``start`` and are ``length`` long, one run after the other."""
    length = length.astype(np.int64)
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def per_text(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of ``weights``, by text number, as whole numbers."""
    return np.bincount(doc, weights, minlength=n).astype(np.int64)
