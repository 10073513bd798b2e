"""The stored collections: tables of parquet folders under one commit record.

A store is a folder. Every commit is a small record, ``commits/<version>.json``, that names for each table the
folders its rows are in; what a commit does not touch is named as before and not written again. So all tables
change together, readers of a version always see the same rows, and a second writer that started from the same
version is refused.

Tables come in two kinds. A *keyed* table has one row per key in a fixed number of hash buckets; a commit
replaces whole buckets or lays a layer over them: rows that stand for earlier ones, or only the names of rows
that are gone. Readers leave out what a later layer hides, by the few columns that name a row. Rows are sorted by
key within a layer and the key columns carry Bloom filters, so a lookup reads one bucket and few row groups of
it. A *grown* table is a list of folders; a commit adds some or replaces several by one.

The record has one entry per bucket or folder, never one per row: it is small whatever the tables hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.sources.files import Folder

BUCKET, FOLDER = "__bucket", "__folder"
DEFAULT_BUCKETS = 64
CODEC = "zstd"


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


def bucket_of(key: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def commit_of(folder: Column) -> Column:
    """The version that wrote a folder, from its name."""
    return F.substring(folder, 1, 8).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Folder(spark, self.root)

    def versions(self) -> list[int]:
        """Numbers of all commits, oldest first."""
        return [int(n.split(".")[0]) for n in self.files.names("commits") if n[0].isdigit() and n.endswith(".json")]

    def record(self, version: int | None = None) -> dict:
        """The commit record of a version, or the newest; an empty one for a new store."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return {"version": 0, "tables": {}}
        if version not in found:
            raise FileNotFoundError(f"no version {version} in {self.root}")
        return json.loads(self.files.read(f"commits/{version:08d}.json"))

    def begin(self) -> Transaction:
        return Transaction(self)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a table, as of a version or the newest."""
        return self.rows(self.record(version), name)

    def lookup(self, name: str, key: Sequence[object], version: int | None = None) -> DataFrame:
        """The row of one key: its bucket is read, and in it the row groups that may hold the key."""
        record = self.record(version)
        entry = record["tables"][name]
        bucket = self.bucket(entry, key)
        rows = self.rows(record, name, buckets=[bucket])
        for column, value in zip(entry["key"], key, strict=True):
            rows = rows.where(F.col(column) == F.lit(value))
        return rows

    def bucket(self, entry: dict, key: Sequence[object]) -> int:
        schema = T.StructType.fromJson(entry["schema"])
        values = [F.lit(v).cast(schema[c].dataType) for c, v in zip(entry["key"], key, strict=True)]
        # The hash is Spark's, so a row of literals is hashed there.
        one = self.spark.range(1).select(bucket_of(values, entry["buckets"]).alias("b"))
        return one.first()["b"]

    def rows(self, record: dict, name: str, buckets: Iterable[int] | None = None, marked: bool = False) -> DataFrame:
        """Rows of a table as a record has it; ``marked`` adds bucket or folder.

        Only the folders of ``buckets`` are listed and read, if they are given.
        """
        entry = record["tables"].get(name)
        if entry is None:
            raise KeyError(f"no table {name} in version {record['version']}")
        schema = T.StructType.fromJson(entry["schema"])
        base = f"{self.root}/data/{name}"
        if entry["kind"] == "keyed":
            return self._keyed(base, entry, schema, buckets, marked)
        paths = [f"{base}/{FOLDER}={f}" for f in entry["files"]]
        mark = T.StructField(FOLDER, T.StringType())
        if not paths:
            empty = T.StructType([*schema.fields, mark]) if marked else schema
            return self.spark.createDataFrame([], empty)
        full = T.StructType([*schema.fields, mark])
        found = self.spark.read.schema(full).option("basePath", base).parquet(*paths)
        return found.select(*schema.names, *([mark.name] if marked else []))

    def _keyed(
        self, base: str, entry: dict, schema: T.StructType, buckets: Iterable[int] | None, marked: bool
    ) -> DataFrame:
        """Rows of some buckets of a keyed table without those that a later layer of their bucket hides."""
        chosen = sorted(entry["files"]) if buckets is None else [str(b) for b in buckets]
        layers = {b: folders for b in chosen if (folders := entry["files"].get(b))}
        bucket, folder = T.StructField(BUCKET, T.IntegerType()), T.StructField(FOLDER, T.StringType())
        names = [*schema.names, *([BUCKET] if marked else [])]

        def read(placed: dict[str, list[str]], fields: Iterable[T.StructField], *marks: T.StructField) -> DataFrame:
            paths = [f"{base}/{FOLDER}={f}/{BUCKET}={b}" for b, folders in sorted(placed.items()) for f in folders]
            full = T.StructType([*fields, *marks])
            if not paths:
                return self.spark.createDataFrame([], full)
            return self.spark.read.schema(full).option("basePath", base).parquet(*paths).select(*full.names)

        gone = set(entry.get("gone", []))
        plain = {b: f for b, f in layers.items() if len(f) == 1}
        parts = [read(plain, schema.fields, bucket).select(*names)] if plain or not layers else []
        if laid := {b: f for b, f in layers.items() if len(f) > 1}:
            rows = read({b: [x for x in f if x not in gone] for b, f in laid.items()}, schema.fields, bucket, folder)
            above = {b: f[1:] for b, f in laid.items()}
            row = [schema[c] for c in entry["row"]]
            named = read(above, row, bucket, folder).select(
                F.col(BUCKET).alias("in"),
                *[F.col(c).alias(f"row_{i}") for i, c in enumerate(entry["row"])],
                commit_of(F.col(FOLDER)).alias("by"),
            )
            last = named.groupBy(*[c for c in named.columns if c != "by"]).agg(F.max("by").alias("by"))
            hides = (F.col(BUCKET) == F.col("in")) & (F.col("by") > commit_of(F.col(FOLDER)))
            for i, c in enumerate(entry["row"]):
                hides = hides & F.col(c).eqNullSafe(F.col(f"row_{i}"))
            parts.append(rows.join(last, hides, "left_anti").select(*names))
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete records before the last ``keep`` and the folders that no kept record names; gives those folders.

        Only for a time when nobody writes: folders of an unfinished commit go too.
        """
        for version in self.versions()[:-keep]:
            self.files.delete(f"commits/{version:08d}.json")
        named = set()
        for version in self.versions():
            for name, entry in self.record(version)["tables"].items():
                files = entry["files"]
                for file in {f for layers in files.values() for f in layers} if entry["kind"] == "keyed" else files:
                    path = f"{name}/{FOLDER}={file}"
                    named |= {path[:k] for k, c in enumerate(path) if c == "/"} | {path}
        dropped: list[str] = []

        def clear(folder: str, inside: bool) -> None:
            """Delete what no record names; below a folder named whole everything stays."""
            for child in self.files.names(f"data/{folder}" if folder else "data"):
                path = f"{folder}/{child}" if folder else child
                if path not in named:
                    if "=" in child or not inside:
                        self.files.delete(f"data/{path}")
                        dropped.append(path)
                elif any(n.startswith(f"{path}/") for n in named):
                    clear(path, path.count("/") > 0)

        clear("", False)
        for name in self.files.names():  # what unfinished writers have laid aside
            if name not in ("commits", "data"):
                self.files.delete(name)
        return dropped


class Transaction:
    """Changes to some tables that become visible together, or not at all."""

    def __init__(self, store: Store) -> None:
        self.store, self.spark = store, store.spark
        self.base = store.record()
        self.version = self.base["version"] + 1
        self.tables = json.loads(json.dumps(self.base["tables"]))
        self.written: dict[str, list[str]] = {}

    def folders(self, name: str, chosen: Iterable[str]) -> DataFrame:
        """Rows of some folders of a grown table, marked with their folder."""
        tables = {name: self.tables[name] | {"files": list(chosen)}}
        return self.store.rows({"version": self.version, "tables": tables}, name, marked=True)

    def has(self, name: str) -> bool:
        return name in self.tables

    def rows(self, name: str, buckets: Iterable[int] | None = None, marked: bool = False) -> DataFrame:
        """Rows of a table as the transaction would leave it now."""
        return self.store.rows({"version": self.version, "tables": self.tables}, name, buckets, marked)

    def _folder(self, name: str) -> tuple[str, str]:
        folder = f"{self.version:08d}-{uuid.uuid4().hex[:12]}"
        self.written.setdefault(name, []).append(folder)
        return folder, f"{self.store.root}/data/{name}/{FOLDER}={folder}"

    def _write_buckets(
        self, name: str, df: DataFrame, key: Sequence[str], buckets: int, placed: bool = False
    ) -> dict[str, list[str]]:
        folder, path = self._folder(name)
        rows = df.withColumn(BUCKET, bucket_of(list(key), buckets))
        rows = rows if placed else rows.repartition(BUCKET)
        writer = rows.sortWithinPartitions(BUCKET, *key).write.partitionBy(BUCKET).option("compression", CODEC)
        # Filters as large as their keys need, not a megabyte each.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.mode("errorifexists").parquet(path)
        found = self.store.files.names(f"data/{name}/{FOLDER}={folder}")
        return {n.split("=")[1]: [folder] for n in found if n.startswith(f"{BUCKET}=")}

    def put(
        self,
        name: str,
        df: DataFrame,
        key: Sequence[str],
        buckets: int = DEFAULT_BUCKETS,
        row: Sequence[str] = (),
        placed: bool = False,
    ) -> None:
        """A keyed table, new or replaced whole; layers name its rows by the columns ``row``, else by the key.

        ``placed`` rows already lie together by bucket and do not move again.
        """
        files = self._write_buckets(name, df, key, buckets, placed)
        self.tables[name] = {
            "kind": "keyed",
            "key": list(key),
            "row": list(row or key),
            "buckets": buckets,
            "schema": df.schema.jsonValue(),
            "files": files,
        }

    def lay(self, name: str, df: DataFrame, placed: bool = False) -> list[int]:
        """Rows that stand for the rows of the same name in a keyed table; gives the buckets they are in.

        ``df`` has all columns of the table, or those of the key and of a row's name only: then the rows go.
        """
        entry = self.tables[name]
        schema = T.StructType.fromJson(entry["schema"])
        whole = set(schema.names) <= set(df.columns)
        columns = schema.names if whole else list(dict.fromkeys([*entry["key"], *entry["row"]]))
        rows = df.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns])
        files = self._write_buckets(name, rows, entry["key"], entry["buckets"], placed)
        if not files:  # nothing was written, so no folder is named
            self.store.files.delete(f"data/{name}/{FOLDER}={self.written[name].pop()}")
            return []
        if not whole:
            files = {b: f for b, f in files.items() if b in entry["files"]}
            entry["gone"] = [*entry.get("gone", []), self.written[name][-1]]
        entry["files"] = entry["files"] | {b: [*entry["files"].get(b, []), *f] for b, f in files.items()}
        return sorted(int(b) for b in files)

    def layers(self, name: str) -> dict[int, int]:
        """How many layers the buckets of a keyed table have."""
        return {int(b): len(f) for b, f in self.tables[name]["files"].items()}

    def laid(self, name: str) -> DataFrame:
        """The rows this transaction has last written to a keyed table, with their bucket."""
        entry, folder = self.tables[name], self.written[name][-1]
        files = {b: [folder] for b, f in entry["files"].items() if f[-1] == folder}
        return self.store.rows({"version": self.version, "tables": {name: entry | {"files": files}}}, name, marked=True)

    def replace_buckets(self, name: str, df: DataFrame, buckets: Iterable[int], placed: bool = False) -> None:
        """The rows of some buckets of a keyed table, which must all lie in those buckets.

        ``placed`` rows already lie together by bucket and do not move again.
        """
        entry = self.tables[name]
        touched = {str(b) for b in buckets}
        files = self._write_buckets(name, df, entry["key"], entry["buckets"], placed)
        if stray := set(files) - touched:
            raise ValueError(f"rows of {name} outside the buckets to replace: {sorted(stray)}")
        entry["files"] = {b: f for b, f in entry["files"].items() if b not in touched} | files
        named = {f for layers in entry["files"].values() for f in layers}
        if "gone" in entry:
            entry["gone"] = [f for f in entry["gone"] if f in named]

    def append(
        self,
        name: str,
        df: DataFrame,
        clustered: Sequence[str] = (),
        files: int | None = None,
        in_place: bool = False,
    ) -> str:
        """One more folder of a grown table, range-clustered by some columns; gives the folder's name.

        Rows ``in_place`` are only sorted by those columns in the partitions they are in.
        """
        folder, path = self._folder(name)
        if clustered:
            spread = [files] if files else []
            df = df if in_place else df.repartitionByRange(*spread, *clustered)
            df = df.sortWithinPartitions(*clustered)
        df.write.mode("errorifexists").option("compression", CODEC).parquet(path)
        entry = self.tables.setdefault(name, {"kind": "grown", "schema": df.schema.jsonValue(), "files": []})
        entry["files"].append(folder)
        return folder

    def append_parts(self, name: str, df: DataFrame, by: Sequence[str]) -> list[str]:
        """One more folder of a grown table, with a part for every value of the ``by`` columns; gives the parts.

        A part can be left out of later versions without a look at its rows.
        """
        folder, path = self._folder(name)
        df.repartition(*by).write.mode("errorifexists").partitionBy(*by).parquet(path)
        found = [folder]
        for _ in by:
            found = [f"{p}/{n}" for p in found for n in self.store.files.names(f"data/{name}/{FOLDER}={p}") if "=" in n]
        ordered = df.select(*[c for c in df.columns if c not in by], *by)
        entry = self.tables.setdefault(name, {"kind": "grown", "schema": ordered.schema.jsonValue(), "files": []})
        entry["files"] += found
        return found

    def forget(self, name: str, folders: Iterable[str]) -> None:
        """Leave some folders of a grown table out of the next version."""
        gone = set(folders)
        self.tables[name]["files"] = [f for f in self.tables[name]["files"] if f not in gone]

    def buckets_of(self, name: str) -> int:
        return self.tables[name]["buckets"]

    def bytes_written(self, name: str) -> int:
        return sum(self.store.files.bytes(f"data/{name}/{FOLDER}={f}") for f in self.written.get(name, []))

    def commit(self) -> int:
        """Make the changes visible as the next version; raises ``Conflict`` if another writer was first."""
        record = {"version": self.version, "tables": self.tables}
        if not self.store.files.create(f"commits/{self.version:08d}.json", json.dumps(record)):
            raise Conflict(f"version {self.version} of {self.store.root} is taken")
        return self.version
