"""Similarity join of word shingle sets by signature trees.

Every text becomes the set of its distinct word shingles. Equal sets are one class, joined as a whole.
Between classes, links (Jaccard similarity at or above a threshold) are searched in a forest:

* A shingle is *common* if at least two classes hold it. What two sets share is common, so a class that is
  linked has the share of the threshold in common shingles; classes that have less are done.
* A *tree* holds the classes that have one shingle among their first ones. The common shingles of a class
  are ordered by the number of classes that hold them, then by hash. A linked pair shares so many that its
  first shared one is early in both: within the first ``common - least overlap + 1``. No pair is lost, and a
  passage shared by unlike texts fills few trees.
* The first pass links each class to the two ends of one of its trees and verifies those pairs. Trees
  whose classes are then in one component are closed: nothing in them can change the result.
* The open trees get *nodes* of bounded size, cut by set size and hash. A node holds the OR of its token
  bitmaps, its range of sizes and its largest number of bit collisions. Node pairs of a tree are pruned
  when they lie in one component or when their largest possible overlap is too small. The classes below
  the pairs that are left are compared by their own bitmaps, and what may still link is verified on the
  whole sets. A tree with very many classes is thus many small groups of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.collocations import Filter, filter_bits
from pageloom.llm.graph import components
from pageloom.llm.storage import ARROW_ROWS, Scratch, settings
from pageloom.llm.textops import mix, slices, span_hashes, text_bytes, windows, word_spans

# 64-bit words of a token bitmap.
BITMAP = 16
# Classes in a node of a tree, on average.
NODE = 64
# Bytes of text a task turns into sets at once, shingles of a block, and rows that go to a Python worker at once.
SLICE, BLOCK, BATCH = 1 << 20, 500_000, 1000
# Shingles of a shard, on average at most: what one task holds while it counts.
SHARD = 1_000_000
LEAST_SHARDS = 24
# Bytes of a shingle in a stored set. Two different shingles are taken for one with a chance of 1 in 2 ** 48.
WIDTH = 6


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by text and hash, and the number of each text's shingles."""
    n = len(offs) - 1
    first, last, doc = word_spans(raw, offs)
    words = span_hashes(raw, first, last, lower=True)
    value, at = windows(words, doc, size)
    owner = doc[at]
    counts = np.bincount(doc, minlength=n)
    for d in np.flatnonzero((counts > 0) & (counts < size)):  # the whole sequence is one shingle
        own = words[np.searchsorted(doc, d) : np.searchsorted(doc, d + 1)]
        one = mix(np.array([len(own)], dtype=np.uint64))
        for k in range(len(own)):
            one = mix(one * np.uint64(31) + own[k : k + 1])
        value, owner = np.append(value, one), np.append(owner, d)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.bincount(owner, minlength=n).astype(np.int64)


def _packed(value: np.ndarray) -> np.ndarray:
    """The low bytes of each hash, one row of ``WIDTH`` bytes per shingle."""
    return np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :WIDTH]


def _unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), dtype=np.uint8)
    out[:, :WIDTH] = data.reshape(-1, WIDTH)
    return out.view(np.int64).ravel()


def digests(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two words per set that tell it from others; nothing for an empty one."""
    out = np.zeros((2, len(count)), dtype=np.uint64)
    full = count > 0
    if full.any():
        begin = (np.cumsum(count) - count)[full]
        out[0, full] = np.add.reduceat(mix(value + np.uint64(11)), begin)
        out[1, full] = np.add.reduceat(mix(value ^ np.uint64(0x5DEECE66D)), begin)
    return out.view(np.int64)


def shingle_table(docs: DataFrame, size: int) -> DataFrame:
    """Per document: set size and set digest (two words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                value, count = shingle_sets(*text_bytes(part.column("text")), size)
                one, two = digests(value, count)
                out = {"doc_id": part.column("doc_id"), "n": pa.array(count), "d1": pa.array(one), "d2": pa.array(two)}
                yield pa.record_batch(out)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, n long, d1 long, d2 long")


def chosen(classes: DataFrame):
    """A broadcast filter, of fixed size, of the documents that stand for classes.

    It says yes to all of them and to a few copies. A copy makes some shingles look common that are not, which
    costs a comparison later; it is never lost or linked wrongly by that.
    """
    spark = classes.sparkSession
    with settings(spark, **{ARROW_ROWS: "10000"}):
        bits = filter_bits(classes.select(F.col("d1").bitwiseXOR(F.col("id")).alias("key")))
    return spark.sparkContext.broadcast(bits)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())


def own_sets(batch: pa.RecordBatch, size: int, stands: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, shingles and set sizes of the documents that stand for a class.

    Sets are made from the texts whenever they are needed and never stored for all documents, as they take
    more room than the texts, nor are texts moved to find out which are needed.
    """
    for part in slices(batch, "text", SLICE):
        value, count = shingle_sets(*text_bytes(part.column("text")), size)
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        own = (count > 0) & stands((digests(value, count)[0] ^ ids).view(np.uint64))
        yield ids[own], value[np.repeat(own, count)], count[own]


def sets_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n`` and ``shingles`` of the classes, and of a few documents more."""
    bits = chosen(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stands = Filter(bits.value)
        for batch in batches:
            for ids, value, count in own_sets(batch, size, stands):
                raw, ends = _packed(value), np.cumsum(count)
                found = [raw[e - c : e].tobytes() for e, c in zip(ends, count, strict=True)]
                yield pa.record_batch({"doc_id": pa.array(ids), "n": pa.array(count), "shingles": pa.array(found, pa.binary())})

    return texts(docs).mapInArrow(work, "doc_id long, n long, shingles binary")


def bitmaps(sets: DataFrame) -> DataFrame:
    """``id``, set size and a token bitmap of ``BITMAP`` words per set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles"):
                raw, offs = text_bytes(part.column("shingles"))
                own = np.repeat(np.arange(part.num_rows), np.diff(offs) // WIDTH)
                bits = np.zeros((part.num_rows, BITMAP * 64), dtype=np.uint8)
                bits[own, _unpacked(raw) % (BITMAP * 64)] = 1
                words = np.packbits(bits, axis=1).view(np.int64).ravel()
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * BITMAP
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words))
                yield pa.record_batch({"id": part.column("doc_id"), "n": part.column("n"), "bits": lists})

    return sets.select("doc_id", "n", "shingles").mapInArrow(work, "id long, n long, bits array<long>")


def asked(docs: DataFrame, classes: DataFrame, size: int, shards: int) -> DataFrame:
    """Blocks of sets, dealt out by shingle: for each shard, shingles and who holds them.

    A shingle that several sets of a block hold is known to be common: its holders go to any shard
    (``known``), and it is told once, with no holder, to the shard that counts it. So one row at most per
    block asks for a shingle, however frequent it is.
    """
    bits = chosen(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stands = Filter(bits.value)
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for block in own_sets(batch, size, stands):
                held.append(block)
                if sum(len(value) for _, value, _ in held) >= BLOCK:
                    yield from dealt(held)
                    held = []
            if held:
                yield from dealt(held)

    def dealt(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, token, count = (np.concatenate(x) for x in zip(*held, strict=True))
        token = _unpacked(_packed(token).ravel())
        own = np.repeat(np.arange(len(ids)), count)
        order = np.argsort(token, kind="stable")
        token, own = token[order], own[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(fresh)
        many = np.diff(np.append(start, len(token)))
        known = np.repeat(many > 1, many)
        told = token[start[many > 1]]
        one = (np.append(token[~known], told), np.append(own[~known], np.full(len(told), len(ids))))
        yield _dealt(*one, np.append(ids, -1), one[0], shards, False)
        yield _dealt(token[known], own[known], ids, own[known] * 7919 + token[known], shards, True)

    return texts(docs).mapInArrow(work, "shard int, known boolean, ids binary, counts binary, shingles binary")


def _dealt(
    token: np.ndarray, own: np.ndarray, ids: np.ndarray, by: np.ndarray, shards: int, known: bool
) -> pa.RecordBatch:
    """One row per shard: the holders, how many shingles each has there, and the shingles."""
    shard = (mix(by.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((own, shard))
    token, own, shard = token[order], own[order], shard[order]
    head = np.ones(len(token), dtype=bool)
    head[1:] = (shard[1:] != shard[:-1]) | (own[1:] != own[:-1])
    start = np.flatnonzero(head)
    counts = np.diff(np.append(start, len(token))).astype(np.int32)
    holder, place = ids[own[start]].astype(np.int64), shard[start]
    names, first = np.unique(place, return_index=True)
    last = np.append(first, len(start))[1:]
    edge = np.append(start, len(token))
    raw = _packed(token)
    return pa.record_batch(
        {
            "shard": pa.array(names, pa.int32()),
            "known": pa.array(np.full(len(names), known)),
            "ids": pa.array([holder[f:l].tobytes() for f, l in zip(first, last, strict=True)], pa.binary()),
            "counts": pa.array([counts[f:l].tobytes() for f, l in zip(first, last, strict=True)], pa.binary()),
            "shingles": pa.array(
                [raw[edge[f] : edge[l]].tobytes() for f, l in zip(first, last, strict=True)], pa.binary()
            ),
        }
    )


def common_shingles(docs: DataFrame, classes: DataFrame, size: int, shards: int) -> DataFrame:
    """``id`` and ``key`` for each shingle of a class's set that another class's holds too."""

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        token, holder = _held(table.filter(pc.invert(table.column("known"))))
        order = np.argsort(token, kind="stable")
        token, holder = token[order], holder[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(fresh)
        many = np.diff(np.append(start, len(token)))
        if len(start):
            many = many + np.add.reduceat((holder < 0).astype(np.int64), start)  # told: two sets at least
        keep = np.repeat(many > 1, np.diff(np.append(start, len(token)))) & (holder >= 0)
        more, owner = _held(table.filter(table.column("known")))
        return pa.table({"id": np.append(holder[keep], owner), "key": np.append(token[keep], more)})

    return asked(docs, classes, size, shards).groupBy("shard").applyInArrow(count, "id long, key long")


def _held(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their holders."""
    ids = b"".join(table.column("ids").to_pylist())
    counts = b"".join(table.column("counts").to_pylist())
    raw = b"".join(table.column("shingles").to_pylist())
    return _unpacked(np.frombuffer(raw, np.uint8)), np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32))


def first_shingles(rows: DataFrame, percent: int) -> DataFrame:
    """The trees that each class is in: its first common shingles. ``rows``: id, n, key."""
    held = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    own = Window.partitionBy("id")
    ranked = rows.join(held, "key").select(
        "id",
        "key",
        F.count("*").over(own).alias("common"),
        F.row_number().over(own.orderBy("held", "key")).alias("place"),
        least_overlap(percent).alias("least"),
    )
    return ranked.where("place <= common - least + 1").select("id", "key")


def least_overlap(percent: int) -> Column:
    """Shingles that a set of n has to share to be linked at all."""
    return F.expr(f"(n * {percent} + 99) div 100")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = len(left.as_buffer()) // WIDTH, len(right.as_buffer()) // WIDTH
                both = np.concatenate([_unpacked(np.frombuffer(s.as_buffer(), dtype=np.uint8)) for s in (left, right)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (x + y - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def spare_bits() -> Column:
    """Shingles of a set that share a bit of its bitmap with others."""
    return F.col("n") - sum(F.bit_count(F.col("bits")[k]) for k in range(BITMAP))


def fits(low: str, high: str, percent: int) -> Column:
    """Whether the largest possible overlap of a and b reaches the threshold.

    Shingles in common set bits in common, except those that share a bit with others of their set.
    """
    shared = sum(F.bit_count(F.col("a.bits")[k].bitwiseAND(F.col("b.bits")[k])) for k in range(BITMAP))
    most = F.least(f"a.{high}", f"b.{high}", shared + F.least("a.spare", "b.spare"))
    return (100 + percent) * most >= percent * (F.col(f"a.{low}") + F.col(f"b.{low}"))


def possible(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""
    rows = shapes.select("id", "n", "bits", spare_bits().alias("spare"))
    met = pairs.alias("p").join(rows.alias("a"), F.col("p.a") == F.col("a.id"))
    met = met.join(rows.alias("b"), F.col("p.b") == F.col("b.id"))
    return met.where(fits("n", "n", percent)).select("p.a", "p.b")


def open_pairs(members: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the open trees. ``members``: key, main, id, comp.

    A tree that is one node needs no traversal: its classes of like size meet at once, without bitmaps, as
    the same pair meets in many trees. Larger trees are traversed.
    """
    sized = members.join(shapes.select("id", "n"), "id")
    total = sized.groupBy("key").agg(F.count("*").alias("total"))
    sized = sized.join(total, "key")
    small = sized.where(F.col("total") <= NODE).select("key", "id", "comp", "n")
    a, b = small.alias("a"), small.alias("b")
    like = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    apart = (F.col("a.comp") != F.col("b.comp")) & (F.col("a.id") < F.col("b.id"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & like)
    met = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    large = sized.where(F.col("total") > NODE).select("key", "main", "id", "comp", "n")
    large = large.join(shapes.select("id", "bits"), "id")
    return possible(met, shapes, percent).union(tree_pairs(large, percent)).distinct()


def tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components in the open trees, by dual traversal.

    ``members``: key, main (a component of the tree), id, n, bits, comp. Nodes hold classes of like size and
    keep the main component apart, so that most node pairs of a tree that is nearly closed are in one.
    """
    fine = F.floor(F.log(F.col("n").cast("double")) * 20)  # sizes of a node differ by 5 %
    main = F.col("comp") == F.col("main")
    rows = members.select("key", "id", "n", "bits", "comp", F.struct(fine.alias("size"), main.alias("main")).alias("kind"))
    parts = rows.groupBy("key", "kind").agg(F.ceil(F.count("*") / NODE).alias("parts"))
    node = F.struct("kind", F.pmod(F.xxhash64("id"), "parts")).alias("node")
    spare = spare_bits()
    rows = rows.join(parts, ["key", "kind"]).select("key", "id", "n", "bits", "comp", node, spare.alias("spare"))
    nodes = rows.groupBy("key", "node").agg(
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max("spare").alias("spare"),
        F.min("comp").alias("first"),
        F.max("comp").alias("last"),
        F.array(*(F.bit_or(F.col("bits")[k]) for k in range(BITMAP))).alias("bits"),
    )

    a, b = nodes.alias("a"), nodes.alias("b")
    one = (F.col("a.first") == F.col("a.last")) & (F.col("b.first") == F.col("b.last"))
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") <= F.col("b.node")))
        .where(~(one & (F.col("a.first") == F.col("b.first"))) & fits("low", "high", percent))
        .select(F.col("a.key").alias("key"), F.col("a.node").alias("na"), F.col("b.node").alias("nb"))
    )
    a = rows.alias("a")
    b = rows.alias("b")
    left = a.join(pairs.alias("p"), (F.col("a.key") == F.col("p.key")) & (F.col("a.node") == F.col("p.na")))
    both = left.join(b, (F.col("p.key") == F.col("b.key")) & (F.col("p.nb") == F.col("b.node")))
    found = both.where((F.col("a.comp") != F.col("b.comp")) & fits("n", "n", percent))
    return _ordered(found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))


def jaccard_join(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents and the component of links they are in.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their names, are not looked at. Words
    are what white space separates, with A-Z folded. Two texts link when 100 * |a and b| is at least
    ``percent`` * |a or b| over their sets of ``size``-word shingles; a shorter text is one shingle.

    Returns doc_id, n_shingles and component_id for each row. Null or empty texts have no shingles and are
    linked with nothing (component_id is their own doc_id). Repeated rows are repeated in the result; rows
    of one doc_id with several texts count as one document when links are followed. A row without doc_id
    is compared with nothing and gets no component. An empty table gives an empty one.
    """
    sigs = scratch.save(shingle_table(docs, size), "digests", BATCH)
    classes = sigs.where("n > 0 and doc_id is not null").groupBy("d1", "d2")
    classes = scratch.save(classes.agg(F.min("doc_id").alias("id"), F.min("n").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD))
    common = scratch.save(common_shingles(docs, classes, size, shards), "common", BATCH)

    # Only classes with enough common shingles can be linked; the rest is not looked at again.
    count = common.groupBy("id").agg(F.count("*").alias("common"))
    sizes = classes.groupBy("id").agg(F.min("n").alias("n"))  # an id with several texts: one bound for all
    alive = count.join(sizes, "id").where(F.col("common") >= least_overlap(percent))
    alive = scratch.save(alive.select("id", "n"), "alive")
    heads = scratch.save(first_shingles(common.join(alive, "id"), percent), "heads")
    scratch.drop("common")
    trees = (
        heads.groupBy("key")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low <> high")
    )
    members = scratch.save(heads.join(trees, "key"), "members")
    needed = scratch.save(classes.join(members.select("id").distinct(), "id", "left_semi"), "needed")
    sets = scratch.save(sets_of(docs, needed, size), "needed-sets", BATCH)
    shape = scratch.save(bitmaps(sets), "shapes", BATCH)

    ends = members.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = ends.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    pairs = scratch.save(possible(_ordered(pairs), shape, percent), "pairs-1")
    links = scratch.save(verified(pairs, sets, percent), "links-1", BATCH)
    found = scratch.save(components(links, scratch, "stars-1"), "components-1")

    # Second pass: in trees still open, each class with the ends of the tree that are in other components.
    placed = _placed(members.select("key", "id"), found)
    span = placed.groupBy("key").agg(
        F.min(F.struct("comp", "id")).alias("one"), F.max(F.struct("comp", "id")).alias("two")
    )
    open_ = placed.join(span.where("one.comp <> two.comp"), "key")
    pairs = open_.select("id", "comp", F.explode(F.array("one", "two")).alias("end")).where("comp <> end.comp")
    pairs = pairs.groupBy("id", F.col("end.comp").alias("to")).agg(F.min("end.id").alias("b"))
    pairs = possible(_ordered(pairs.select(F.col("id").alias("a"), "b")), shape, percent)
    pairs = scratch.save(pairs, "pairs-2")
    more = verified(pairs, _of(sets, pairs, scratch, "ids-2"), percent)
    found = _joined(found, scratch.save(more, "links-2", BATCH), scratch, 2)

    # Third pass: what is still open goes through the trees.
    placed = _placed(members.select("key", "id"), found)
    span = placed.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("two"))
    still = span.where("one <> two").select("key", F.col("one").alias("main"))
    open_ = scratch.save(placed.join(still, "key"), "open")
    if not open_.isEmpty():
        candidates = scratch.save(open_pairs(open_, shape, percent), "candidates")
        more = verified(candidates, _of(sets, candidates, scratch, "ids-3"), percent)
        found = _joined(found, scratch.save(more, "links-3", BATCH), scratch, 3)

    rooted = classes.join(found, classes.id == found.node, "left").select(
        "d1", "d2", F.coalesce("component", "id").alias("root")
    )
    out = sigs.select("doc_id", "n", "d1", "d2").join(rooted, ["d1", "d2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _of(sets: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The sets of the documents in ``pairs``; their ids are written first, so Spark knows how many they are."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return sets.join(scratch.save(ids, name), "doc_id", "left_semi")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    comp = found.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _joined(found: DataFrame, links: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """The components after further links: only the graph of components is solved again."""
    if links.isEmpty():
        return found
    comp = found.select("node", "component")
    ends = links.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = scratch.save(components(ends, scratch, f"stars-{turn}"), f"merged-{turn}")
    both = comp.union(merged.select("node", F.col("node").alias("component")).join(comp, "node", "left_anti"))
    renamed = both.join(merged.toDF("component", "to"), "component", "left")
    renamed = renamed.select("node", F.coalesce("to", "component").alias("component"))
    return scratch.save(renamed, f"components-{turn}")
