"""Saving crawled pages to a store: one row per url, versions, and all that is kept beside the pages.

One commit holds the pages, the roll-up and the text index, so each reader sees all of them at the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators import rollups
from pageloom.operators.dedup import HASH, latest_per_url
from pageloom.plans.textindex import TextIndex
from pageloom.session import short_batches, shuffles_dropped
from pageloom.sources.store import BUCKET, CODEC, DEFAULT_BUCKETS, Store, Transaction, bucket_of

PAGES = "pages"
# Pages lie in buckets by their id, which follows from the url, so both find a page in one bucket.
KEY = ("_id",)
STAGE = "staged"
# A bucket of more layers is written again as one, so readers meet a few and a page is written again now and then.
LAYERS = 4


@dataclass(frozen=True)
class Saved:
    """What a commit did: its version, pages by outcome, buckets and bytes of pages written."""

    version: int
    added: int
    changed: int
    removed: int
    buckets: tuple[int, ...]
    page_bytes: int


def _nothing(pages: DataFrame) -> Column:
    """The measures of a page that is not there."""
    return F.lit(None).cast(pages.select(rollups.measures()).schema[0].dataType)


class PageStore:
    def __init__(self, store: Store, buckets: int = DEFAULT_BUCKETS, indexed: bool = True) -> None:
        self.store, self.buckets = store, buckets
        self.index = TextIndex() if indexed else None

    def pages(self, version: int | None = None) -> DataFrame:
        return self.store.table(PAGES, version)

    def save(self, batch: DataFrame, collections: dict[str, tuple[DataFrame, tuple[str, ...]]] | None = None) -> Saved:
        """Add new pages and replace changed ones, as ``dedup.upsert_pages`` does to a table.

        Of stored pages, only hash, version, first sight and measures are read, in the buckets that the batch
        falls into; of the batch only new and changed pages are written, as a layer over those buckets. Texts
        move once, to their bucket. Whole ``collections`` (rows and key, by name) may be saved in the same commit.
        """
        with shuffles_dropped(self.store.spark), short_batches(self.store.spark):
            return self._save(batch, collections or {})

    def _save(self, batch: DataFrame, collections: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> Saved:
        tx = self.store.begin()
        batch = batch.withColumn(BUCKET, bucket_of(KEY, tx.buckets_of(PAGES) if tx.has(PAGES) else self.buckets))
        if tx.has(PAGES):
            stored = self._heads(tx, _numbers(batch))
            fresh = self._lay(tx, batch, stored)
        else:
            stored = None
            tx.put(PAGES, self._newest(batch, None).drop(BUCKET), KEY, self.buckets, row=("url",), placed=True)
            fresh = tx.laid(PAGES)
        changes = self._stage(tx, self._changes(batch, fresh, stored), "changes")
        self._keep(tx, fresh, changes)
        for name, (rows, key) in collections.items():
            tx.put(name, rows, key)
        return self._commit(tx, changes)

    def delete(self, ids: DataFrame) -> Saved:
        """Remove the pages whose ``_id`` is in ``ids``; only their names are written."""
        with shuffles_dropped(self.store.spark):
            return self._delete(ids)

    def _delete(self, ids: DataFrame) -> Saved:
        tx = self.store.begin()
        wanted = ids.select("_id").distinct().withColumn(BUCKET, bucket_of(KEY, tx.buckets_of(PAGES)))
        wanted = self._stage(tx, wanted, "ids")
        buckets = _numbers(wanted)
        found = tx.rows(PAGES, buckets, marked=True).join(wanted.select("_id"), "_id", "left_semi")
        changes = found.select(
            *("_id", "url", BUCKET),
            rollups.measures().alias("old"),
            _nothing(found).alias("new"),
            F.col("version").alias("stored"),
        )
        changes = self._stage(tx, changes, "changes")
        if touched := _numbers(changes):
            tx.lay(PAGES, changes)
            self._fold(tx, touched)
        self._keep(tx, None, changes)
        return self._commit(tx, changes)

    def _stage(self, tx: Transaction, df: DataFrame, name: str) -> DataFrame:
        """Narrow rows written aside for the time of the commit, so that several steps read and none computes them again."""
        path = f"{self.store.root}/{STAGE}/{tx.version:08d}/{name}"
        df.write.mode("overwrite").option("compression", CODEC).parquet(path)
        return tx.spark.read.schema(df.schema).parquet(path)

    def _heads(self, tx: Transaction, buckets: list[int]) -> DataFrame:
        """What a save needs to know of stored pages."""
        return tx.rows(PAGES, buckets, marked=True).select(
            F.col(BUCKET),
            "url",
            F.struct(
                F.col(HASH).alias("hash"),
                F.col("version").alias("version"),
                F.col("metadata.scraped_at").alias("first"),
                rollups.measures().alias("old"),
            ).alias("head"),
        )

    def _newest(self, batch: DataFrame, heads: DataFrame | None) -> DataFrame:
        """The newest row of every url of the batch with the head stored for it, moved once, to their bucket."""
        names = [c for c in batch.columns if c not in ("url", BUCKET)]
        rows = batch.where(F.col("url").isNotNull()).select(BUCKET, "url", F.struct(*names).alias("row"))
        newest = F.max_by("row", F.struct("row.metadata.scraped_at", f"row.{HASH}"))
        version = F.col("version").cast("int")
        if heads is None:
            found = rows.repartition(BUCKET).groupBy(BUCKET, "url").agg(newest.alias("row"))
            return found.select("url", "row.*", BUCKET).withColumn("version", version)
        none = F.lit(None)
        both = rows.withColumn("head", none.cast(heads.schema["head"].dataType)).unionAll(
            heads.select(BUCKET, "url", none.cast(rows.schema["row"].dataType).alias("row"), "head")
        )
        newest = F.max_by("row", F.when(F.col("row").isNotNull(), F.struct("row.metadata.scraped_at", f"row.{HASH}")))
        found = both.repartition(BUCKET).groupBy(BUCKET, "url").agg(
            newest.alias("row"), F.max_by("head", F.when(F.col("head").isNotNull(), 1)).alias("head")
        )
        return found.where(F.col("row").isNotNull()).select("url", "row.*", "head", BUCKET)

    def _lay(self, tx: Transaction, batch: DataFrame, heads: DataFrame) -> DataFrame:
        """Writes the new and changed pages of the batch, with their version and first sight, over the stored ones."""
        found = self._newest(batch, heads)
        known = F.col("head").isNotNull()
        differs = ~known | ~F.col("head.hash").eqNullSafe(F.col(HASH))
        seen = F.when(known, F.col("head.first")).otherwise(F.col("metadata.scraped_at"))
        found = found.where(differs).withColumns(
            {
                "version": F.coalesce(F.col("head.version") + 1, F.col("version")).cast("int"),
                "metadata": F.col("metadata").withField("scraped_at", seen),
            }
        )
        if touched := tx.lay(PAGES, found, placed=True):
            fresh = tx.laid(PAGES)
            self._fold(tx, touched)
            return fresh
        return tx.rows(PAGES, [], marked=True)

    def _fold(self, tx: Transaction, touched: list[int]) -> None:
        """Buckets of many layers are written again as one."""
        high = [b for b, n in tx.layers(PAGES).items() if b in touched and n > LAYERS]
        if high:
            tx.replace_buckets(PAGES, tx.rows(PAGES, high), high)

    def _changes(self, batch: DataFrame, fresh: DataFrame, heads: DataFrame | None) -> DataFrame:
        """Pages of the batch that are new or differ, with their measures before and after.

        A page without a url is not stored, but counts as it always did.
        """
        new = rollups.measures().alias("new")
        nameless = latest_per_url(batch.where(F.col("url").isNull())).select("_id", "url", BUCKET, new)
        rows = fresh.select("_id", "url", BUCKET, new).unionAll(nameless)
        if heads is None:
            return rows.select("_id", "url", BUCKET, _nothing(fresh).alias("old"), "new")
        before = heads.select(F.col(BUCKET).alias("b"), F.col("url").alias("u"), F.col("head.old").alias("old"))
        joined = rows.join(before, (F.col(BUCKET) == F.col("b")) & (F.col("url") == F.col("u")), "left")
        return joined.select("_id", "url", BUCKET, "old", "new")

    def _keep(self, tx: Transaction, fresh: DataFrame | None, changes: DataFrame) -> None:
        """Brings roll-up and index to the state after the changes."""
        if PAGES in tx.base["tables"] and not _numbers(changes):
            return
        rollups.maintain(tx, changes)
        if self.index is not None:
            self.index.change(tx, fresh, changes.where(F.col("old").isNotNull()).select("_id"))

    def _commit(self, tx: Transaction, changes: DataFrame) -> Saved:
        counts = changes.agg(
            F.count_if(F.col("old").isNull()).alias("added"),
            F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("changed"),
            F.count_if(F.col("new").isNull()).alias("removed"),
        ).first()
        touched = tuple(_numbers(changes))
        written = tx.bytes_written(PAGES)
        version = tx.commit()
        self.store.files.delete(f"{STAGE}/{tx.version:08d}")
        return Saved(version, counts["added"], counts["changed"], counts["removed"], touched, written)


def _numbers(rows: DataFrame) -> list[int]:
    """The buckets rows lie in; a list no longer than the table has buckets."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
