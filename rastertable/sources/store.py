"""Catalog tables on any file system Spark can write to.

Every change writes whole new tables into a folder of their own and then one
commit record naming the folders. The record is the only thing readers look
at, so ``datasets`` and ``metadata`` always change together, and a writer that
dies before its record leaves the catalog as it was and nothing in the way of
the next one. The record of a version has one name, which only one writer can
make; the writer of another record of that version gets an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.operators.catalog import Catalog, CatalogError
from rastertable.sources.shared import create_once

TABLES = ("key_names", "datasets", "metadata", "catalog_version")
COMMIT_SCHEMA = "version LONG, token STRING, " + ", ".join(f"{t} STRING" for t in TABLES)


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _commits(self) -> DataFrame:
        return (self.spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true")
                .json(f"{self.root}/commits"))

    def _latest(self):
        """The newest commit record that counts: one row, whatever the catalog holds."""
        order = [F.desc("version"), F.asc("_metadata.file_modification_time"), F.asc("token")]
        try:
            rows = self._commits().orderBy(*order).limit(1).collect()
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return None
        return rows[0] if rows else None

    def exists(self) -> bool:
        return self._latest() is not None

    def load(self) -> Catalog:
        last = self._latest()
        if last is None:
            raise FileNotFoundError(f"no catalog at {self.root}")
        tables = {t: self.spark.read.parquet(f"{self.root}/{last[t]}") for t in TABLES}
        return Catalog(**tables).check_version()

    def save(self, catalog: Catalog) -> Catalog:
        """Write a new version."""
        last = self._latest()
        version, token = 1 if last is None else last["version"] + 1, uuid.uuid4().hex
        folder = f"tables/{version:08d}-{token}"
        names = {}
        for t in TABLES:
            getattr(catalog, t).write.parquet(f"{self.root}/{folder}/{t}", mode="errorifexists")
            names[t] = f"{folder}/{t}"
        record = {"version": version, "token": token, **names}
        if not create_once(self.spark, f"{self.root}/commits/v{version:08d}.json", json.dumps(record)):
            raise CatalogError(f"another writer has made version {version}; load the catalog and apply the change again")
        return self.load()
