"""Near duplicates of embeddings by collision-counting projections.

Vectors are projected on many random lines. In each of ``tables`` sorted orders a vector collides with those
inside a window around its own projection; the order is kept apart by the signs of ``bits`` more
projections, so a window holds neighbours in more than one direction and not a share of all vectors. Pairs
are counted over the tables, and those with ``NEED`` collisions or more are verified in double precision.

The number of bits follows the number of vectors (windows then hold a bounded number of strangers) and the
number of tables is calibrated so that a pair just at the threshold reaches ``NEED`` collisions with
probability ``recall``; closer pairs do so with a higher one. Equal vectors are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.graph import components
from pageloom.llm.storage import Scratch

NEED = 2
RECALL = 0.995
# Half width of a window in standard deviations of the difference of a pair at the threshold.
WIDTH = 2.0
SEED = 11


def plan(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int, float]:
    """Bits, tables and half width of the window for ``n`` vectors."""
    bits = max(4, round(math.log2(max(n, 2))) - 4)
    width = WIDTH * math.sqrt(2 - 2 * cosine)
    hit = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    tables = NEED
    while sum(math.comb(tables, k) * hit**k * (1 - hit) ** (tables - k) for k in range(NEED)) > 1 - recall:
        tables += 1
    return bits, tables, width


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length 1 in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def projected(vectors: DataFrame, bits: int, tables: int, width: float) -> DataFrame:
    """Rows (bucket, cell, own, place, id): each class in each table's cell and, as a guest, in the one below."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            for dim in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dim))
                if dim not in lines:
                    lines[dim] = np.random.Generator(np.random.PCG64(SEED)).standard_normal((tables * (bits + 1), dim))
                spots = (unit_rows(rows.column("vector")) @ lines[dim].T).reshape(-1, tables, bits + 1)
                signs = (spots[:, :, 1:] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                table = np.arange(tables, dtype=np.int64)
                bucket = ((signs * tables + table) << 16) + int(dim)
                place = spots[:, :, 0]
                cell = np.floor(place / width).astype(np.int64)
                ids = np.repeat(np.asarray(rows.column("id")), tables)
                for guest in (0, 1):
                    yield pa.record_batch(
                        {
                            "bucket": bucket.ravel(),
                            "cell": (cell - guest).ravel(),
                            "own": np.full(cell.size, guest == 0),
                            "place": place.ravel(),
                            "id": ids,
                        }
                    )

    return vectors.select("id", "dim", "vector").mapInArrow(
        work, "bucket long, cell long, own boolean, place double, id long"
    )


def collisions(rows: DataFrame, width: float) -> DataFrame:
    """Pairs (a, b) with the number of tables in which they share a window."""
    home = rows.where("own").select("bucket", "cell", F.col("place").alias("pa"), F.col("id").alias("ia"))
    near = rows.select("bucket", "cell", "own", F.col("place").alias("pb"), F.col("id").alias("ib"))
    met = home.join(near, ["bucket", "cell"])
    met = met.where((F.abs(F.col("pa") - F.col("pb")) <= width) & (~F.col("own") | (F.col("ia") < F.col("ib"))))
    met = met.where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


def verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is at least ``cosine``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            for dim in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dim))
                x, y = (
                    rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    for c in ("va", "vb")
                )
                norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
                near = (x * y).sum(axis=1) / norm >= cosine
                yield rows.select(["a", "b", "na", "nb"]).filter(pa.array(near))

    one = vectors.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("n").alias("na"), "dim")
    two = vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("n").alias("nb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "dim", "va", "vb")
    return rows.mapInArrow(work, "a long, b long, na long, nb long")


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding)``.

    Null vectors, zero vectors and those with null or non-finite components are linked with nothing: they
    have no links and are their own component. Vectors of different length are never linked. Repeated rows
    are vectors of their own; they link with each other. Rows without vec_id take no part: no links, no
    component, not kept. Other columns are not looked at. An empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # -0.0 is 0.0, so that equal vectors have equal hashes.
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))
    keys = {"h1": F.xxhash64(plain), "h2": F.xxhash64(F.lit(1), plain)}
    marked = rows.withColumns({"good": good, **keys})
    classes = (
        marked.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    )
    classes = scratch.save(classes, "classes")
    heads = marked.where("good").join(classes.withColumnRenamed("id", "vec_id"), ["vec_id", "h1", "h2"])
    heads = heads.dropDuplicates(["vec_id", "h1", "h2"])
    heads = heads.select(F.col("vec_id").alias("id"), "n", F.size("vector").alias("dim"), "vector")
    heads = scratch.save(heads, "heads")
    bits, tables, width = plan(heads.count(), cosine)
    placed = scratch.save(projected(heads, bits, tables, width), "placed")
    pairs = collisions(placed, width).where(F.col("n") >= NEED).select("a", "b")
    links = scratch.save(verified(pairs, heads, cosine), "links")
    found = scratch.save(components(links, scratch, "stars"), "components")
    ends = links.select(F.col("a").alias("id"), F.col("nb").alias("m"))
    ends = ends.union(links.select(F.col("b").alias("id"), F.col("na").alias("m")))
    others = ends.groupBy("id").agg(F.sum("m").alias("others"))
    whole = classes.join(others, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    whole = whole.select(
        "h1",
        "h2",
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "id").alias("root"),
    )
    out = marked.select("vec_id", "good", "h1", "h2").join(whole, ["h1", "h2"], "left")
    root = F.expr("if(good, root, vec_id)")
    return out.select(
        "vec_id",
        F.expr("if(good, links, 0)").cast("long").alias("n_links"),
        root.alias("component_id"),
        F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"),
    )
