"""A catalog as a log of small changes: a commit costs what it changes, not what the catalog holds.

Every commit writes its rows, with tombstones for what it removes, into a folder of its own (a delta), and then one record
``log/v<version>.json`` that names the base and the deltas since. Records are made by a rename that fails if the name is taken, so of two
writers of one version exactly one succeeds, on whatever clock; changes that do not depend on what is there are tried again on top of the winner's.
Readers merge: of the rows of a key the one of the latest delta counts. Compaction writes a new base, clustered by
key, with an index of the keys in each file, on which pages are found by key instead of by offset.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.operators.catalog import Catalog, CatalogError, duplicate_keys, only_new, search
from rastertable.sources.shared import create_once

TABLES = ("datasets", "metadata")
COMPACT_AFTER = 16   # deltas that a reader merges before a commit compacts them
FILE_ROWS = 100_000  # rows of a file of the base at most
ATTEMPTS = 20


class CatalogLog:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER, file_rows: int = FILE_ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.compact_after, self.file_rows = compact_after, file_rows

    # --- records ---------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions in order; only names are listed."""
        where, fs = self._fs(f"{self.root}/log")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def record(self, version: int | None = None) -> dict:
        """The record of a version, by default the newest: ``version, keys, base, deltas``."""
        if version is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(f"no catalog at {self.root}")
            version = found[-1]
        rows = self.spark.read.text(f"{self.root}/log/v{version:010d}.json", wholetext=True).collect()  # one short file
        return json.loads(rows[0][0])

    def _claim(self, record: dict) -> bool:
        """Make a record under its version's name; False if another writer has made it already."""
        return create_once(self.spark, f"{self.root}/log/v{record['version']:010d}.json", json.dumps(record))

    # --- commits ----------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, keys: Sequence[str], descriptions: Mapping[str, str] | None = None, **options) -> CatalogLog:
        log = cls(spark, root, **options)
        empty = Catalog.create(spark, keys, descriptions)
        folder = log._folder()
        empty.key_names.write.parquet(f"{folder}/key_names")
        empty.catalog_version.write.parquet(f"{folder}/catalog_version")
        if not log._claim({"version": 1, "keys": list(empty.keys), "head": folder, "base": None, "deltas": []}):
            raise CatalogError(f"there is a catalog at {root} already")
        return log

    def _folder(self) -> str:
        return f"{self.root}/tables/{uuid.uuid4().hex}"

    def _commit(self, folder: str, again: bool = True, tag: tuple[str, int] | None = None) -> int:
        for _ in range(ATTEMPTS):
            last = self.record()
            tags = dict(last.get("tags", {}))
            if tag is not None:
                if tags.get(tag[0], -1) >= tag[1]:
                    return last["version"]
                tags[tag[0]] = tag[1]
            if self._claim({**last, "version": last["version"] + 1, "deltas": [*last["deltas"], folder], "tags": tags}):
                if len(last["deltas"]) + 1 >= self.compact_after:
                    self.compact()
                return last["version"] + 1
            if not again:
                raise CatalogError("another writer has changed the catalog; load it and apply the change again")
        raise CatalogError(f"other writers were faster {ATTEMPTS} times")

    def _checked(self, rows: DataFrame, keys: list[str], what: str) -> None:
        if set(keys) - set(rows.columns):
            raise CatalogError(f"{what} need the keys {keys}")
        if not duplicate_keys(rows, keys).isEmpty():
            raise CatalogError(f"{what} with the same keys")

    def _write(self, folder: str, table: str, keep: DataFrame | None, drop: DataFrame | None, keys: list[str]) -> None:
        shape = getattr(Catalog.create(self.spark, keys), table)
        parts = []
        if keep is not None:
            have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in keep.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.schema]
            parts.append(keep.select(*have, F.lit(False).alias("gone")))
        if drop is not None:
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in shape.schema if f.name not in keys]
            parts.append(drop.select(*[F.col(k).cast("string").alias(k) for k in keys], *rest, F.lit(True).alias("gone")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows.write.parquet(f"{folder}/{table}")

    def upsert(self, datasets: DataFrame, metadata: DataFrame | None = None) -> int:
        """Insert or replace datasets; old metadata of replaced ones goes unless given anew. The new version's number."""
        keys = self.record()["keys"]
        self._checked(datasets, keys, "datasets")
        if metadata is not None:
            self._checked(metadata, keys, "metadata rows")
        folder = self._folder()
        self._write(folder, "datasets", datasets, None, keys)
        stale = datasets if metadata is None else only_new(datasets, metadata, keys)
        self._write(folder, "metadata", metadata, stale, keys)
        return self._commit(folder)

    def apply(self, datasets: DataFrame, metadata: DataFrame, gone: DataFrame, tag: tuple[str, int]) -> int:
        """Upsert datasets with their metadata and remove others, present or not, once: a ``tag`` (name, number) that the log has seen, or a later
        number of the same name, changes nothing. For writers that may run a step again."""
        record = self.record()
        if record.get("tags", {}).get(tag[0], -1) >= tag[1]:
            return record["version"]
        keys, folder = record["keys"], self._folder()
        self._checked(datasets, keys, "datasets")
        self._checked(metadata, keys, "metadata rows")
        self._write(folder, "datasets", datasets, gone, keys)
        self._write(folder, "metadata", metadata, gone, keys)
        return self._commit(folder, tag=tag)

    def add_metadata(self, metadata: DataFrame) -> int:
        keys = self.record()["keys"]
        self._checked(metadata, keys, "metadata rows")
        folder = self._folder()
        self._write(folder, "metadata", metadata, None, keys)
        return self._commit(folder)

    def delete(self, gone: DataFrame) -> int:
        """Remove datasets by full key; an absent one is an error, so this is not tried again on another writer's change."""
        keys = self.record()["keys"]
        if not only_new(gone.select(*keys), self.load().datasets, keys).isEmpty():
            raise CatalogError("no dataset with some of the given keys")
        folder = self._folder()
        for table in TABLES:
            self._write(folder, table, None, gone.select(*keys).distinct(), keys)
        return self._commit(folder, again=False)

    # --- reading -----------------------------------------------------------------

    def _merged(self, record: dict, table: str, base: DataFrame | None = None) -> DataFrame:
        """Rows of the base and its deltas; of each key the latest counts, and a tombstone removes it. One map-side combined aggregate."""
        keys = record["keys"]
        shape = getattr(Catalog.create(self.spark, keys), table)
        paths = [(n + 1, f"{d}/{table}") for n, d in enumerate(record["deltas"])]
        paths = [(n, p) for n, p in paths if (lambda w, fs: fs.exists(w))(*self._fs(p))]  # metadata alone leaves no datasets
        if base is None and record["base"]:
            base = self.spark.read.parquet(f"{record['base']}/{table}")
        if not paths:
            return shape if base is None else base.select(*shape.columns)
        kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in shape.schema if f.name not in keys) + ">"
        rest = [c for c in shape.columns if c not in keys]
        row = lambda df, n, gone: df.select(*keys, F.lit(n).alias("n"), gone.alias("gone"), F.struct(*rest).cast(kind).alias("row"))
        every = row(shape if base is None else base, 0, F.lit(False))
        for n, p in paths:
            delta = self.spark.read.parquet(p)
            every = every.unionByName(row(delta, n, F.col("gone")))
        last = every.groupBy(*keys).agg(F.max_by(F.struct("gone", "row"), "n").alias("last"))
        return last.where("NOT last.gone").select(*keys, "last.row.*")

    def load(self, version: int | None = None) -> Catalog:
        """The catalog as of a version, by default the newest."""
        record = self.record(version)
        head = record["head"]
        return Catalog(self.spark.read.parquet(f"{head}/key_names"), self._merged(record, "datasets"), self._merged(record, "metadata"),
                       self.spark.read.parquet(f"{head}/catalog_version")).check_version()

    def compact(self) -> int:
        """Merge the deltas into a new base, in files by key range. Readers of older versions keep theirs; a faster writer's change makes this a no-op."""
        last = self.record()
        folder, keys = self._folder(), last["keys"]
        for table in TABLES:  # a task writes many files: tasks and the sample of their ranges, which the driver gets, do not grow with the files
            rows = self._merged(last, table).repartitionByRange(*keys).sortWithinPartitions(*keys)
            rows.write.option("maxRecordsPerFile", self.file_rows).parquet(f"{folder}/{table}")
        whole = F.struct(*keys)
        index = (self.spark.read.parquet(f"{folder}/datasets").groupBy(F.col("_metadata.file_path").alias("file"))
                 .agg(F.min(whole).alias("low"), F.max(whole).alias("high"), F.count(F.lit(1)).alias("n")))
        index.write.parquet(f"{folder}/index")  # one row per file
        record = {**last, "version": last["version"] + 1, "base": folder, "deltas": []}
        return record["version"] if self._claim(record) else last["version"]

    # --- pages by key ---------------------------------------------------------------

    def page_after(self, cursor: Sequence[str] | None = None, limit: int = 100, where=None) -> DataFrame:
        """The first ``limit`` datasets, by key, behind ``cursor`` (the keys of the last one seen; None: from the start).

        The index tells the files of the base that follow the cursor and hold enough rows; only those are read, and of the deltas the rows of
        their key range. Where deletions or ``where`` leave too few rows, as many files more are read as were before, until the end.
        """
        record = self.record()
        keys = record["keys"]
        tuple_of = F.struct(*keys)
        behind = lambda c: F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, c, strict=True)])
        after: Column = F.lit(True) if cursor is None else tuple_of > behind(cursor)
        if not record["base"]:
            return search(self._merged(record, "datasets").where(after), keys, where).orderBy(*keys).limit(limit)
        index = self.spark.read.parquet(f"{record['base']}/index")
        if cursor is not None:
            index = index.where(F.col("high") > behind(cursor))
        take = 2
        while True:
            files = index.orderBy("low").limit(take + 1).collect()  # a few rows of the index
            more, files = len(files) > take, files[:take]
            schema = getattr(Catalog.create(self.spark, keys), "datasets").schema
            base = self.spark.read.schema(schema).parquet(*[f["file"] for f in files]) if files else self.spark.createDataFrame([], schema)
            own = self._merged(record, "datasets", base).where(after)
            if more:  # what lies behind the files read comes on a later page
                own = own.where(tuple_of <= behind(list(files[-1]["high"])))
            page = search(own, keys, where).orderBy(*keys).limit(limit)
            if not more or page.count() >= limit:
                return page
            take *= 2
