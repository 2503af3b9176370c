"""The dataset catalog: four tables and the operations between them.

    key_names        key_name, description, idx
    datasets         one STRING column per key, path
    metadata         one STRING column per key, statistics columns
    catalog_version  version
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.sources.paths import duplicate_keys, move_key_last

# fixed values
VERSION = "0.9.0"
RESERVED_KEYS = ("limit", "page")
METADATA_COLUMNS = {
    "west": "double", "south": "double", "east": "double", "north": "double",
    "convex_hull": "string", "valid_percentage": "double", "min": "double", "max": "double",
    "mean": "double", "stdev": "double", "percentiles": "array<float>", "metadata": "string",
}


class CatalogError(ValueError):
    """A request the catalog cannot answer: wrong keys, absent datasets, other version."""


# --- keys -------------------------------------------------------------------

@dataclass(frozen=True)
class KeySchema:
    """The ordered key names of a catalog, and the requests that fit them."""

    names: tuple[str, ...]

    @classmethod
    def declared(cls, names: Sequence[str], described: Mapping[str, str] | None = None) -> KeySchema:
        """A schema for a new catalog; all that is wrong with it is told at once."""
        names = tuple(names)
        faults = [f"{n!r} is not alphanumeric" for n in names if not re.fullmatch(r"\w+", n)]
        faults += [f"{n!r} is reserved" for n in RESERVED_KEYS if n in names]
        faults += [f"{n!r} is named twice" for n in dict.fromkeys(names) if names.count(n) > 1]
        faults += [f"{n!r} is described but no key" for n in described or () if n not in names]
        if faults or not names:
            raise CatalogError("; ".join(faults) or "a catalog needs at least one key")
        return cls(names)

    def some(self, given) -> dict:
        """Values by key name, from a mapping or from values of the first keys in order."""
        if given is None:
            return {}
        if isinstance(given, Mapping):
            strange = given.keys() - set(self.names)
            if strange:
                raise CatalogError(f"no such keys: {sorted(strange)}; the catalog has {list(self.names)}")
            return dict(given)
        if isinstance(given, (str, bytes)) or not isinstance(given, Sequence) or len(given) > len(self.names):
            raise CatalogError(f"give a mapping or at most {len(self.names)} values, for {list(self.names)}")
        return {name: given[i] for i, name in enumerate(self.names[:len(given)])}

    def every(self, given) -> tuple[str, ...]:
        """One value per key, as texts in order."""
        named = self.some(given)
        if len(named) < len(self.names):
            raise CatalogError(f"a dataset has all of the keys {list(self.names)}")
        return tuple(str(named[n]) for n in self.names)


def keys_table(spark: SparkSession, keys: Sequence[str], descriptions=None) -> DataFrame:
    descriptions = descriptions or {}
    KeySchema.declared(keys, descriptions)
    rows = [(k, descriptions.get(k, ""), i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "key_name STRING, description STRING, idx INT")


def list_keys(key_names: DataFrame) -> DataFrame:
    """Keys in order; an empty description is absent."""
    return key_names.orderBy("idx").select("key_name", F.nullif("description", F.lit("")).alias("description"))


# --- search -----------------------------------------------------------------

def search(datasets: DataFrame, key_names: Sequence[str], where=None) -> DataFrame:
    """Datasets whose keys all match; a list of values means any of them, an empty list none."""
    for key, values in KeySchema(tuple(key_names)).some(where).items():
        values = values if isinstance(values, (list, tuple, set)) else [values]
        datasets = datasets.where(F.col(key).isin([str(v) for v in values]) if values else F.lit(False))
    return datasets


def page_of(datasets: DataFrame, key_names: Sequence[str], page: int = 0, limit: int | None = None) -> DataFrame:
    """One page in the order of all key columns, then path. Without a limit the page is ignored."""
    if page < 0 or (limit is not None and limit < 0):
        raise ValueError("page and limit cannot be negative")
    ordered = datasets.orderBy(*key_names, "path")
    return ordered if limit is None else ordered.offset(page * limit).limit(limit)


# --- metadata ---------------------------------------------------------------

def metadata_columns(metadata: DataFrame, key_names: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Chosen metadata columns (all by default) and the ``keys`` struct."""
    if columns is not None and not columns:
        raise ValueError("columns must name at least one column or be None")
    available = [c for c in metadata.columns if c not in key_names]
    chosen = list(columns) if columns is not None else available
    absent = [c for c in chosen if c not in available]
    if absent:
        raise KeyError(f"no metadata column {absent}")
    return metadata.select(*chosen, F.struct(*key_names).alias("keys"))


def metadata_of(metadata: DataFrame, key_names: Sequence[str], keys) -> DataFrame:
    """Metadata row of one dataset, by its full key."""
    for k, v in zip(key_names, KeySchema(tuple(key_names)).every(keys), strict=True):
        metadata = metadata.where(F.col(k) == F.lit(v))
    return metadata


def metadata_batch(requests: DataFrame, metadata: DataFrame, key_names: Sequence[str],
                   columns: Sequence[str] | None = None, on_missing: str = "error") -> DataFrame:
    """Metadata for a table of requested key tuples.

    ``requests`` has an ``ordinal`` column and the keys; its order and its
    duplicates are kept. A request without metadata fails the job, or with
    ``on_missing='null'`` yields NULL columns and ``found = false``.
    """
    found = metadata_columns(metadata, key_names, columns)
    names = [c for c in found.columns if c != "keys"]
    hit = found.withColumn("_hit", F.lit(True))
    on = [F.col(f"q.{k}") == F.col(f"m.keys.{k}") for k in key_names]
    joined = requests.alias("q").join(hit.alias("m"), on, "left")
    present = F.coalesce(F.col("m._hit"), F.lit(False))
    out = joined.select(
        F.col("q.ordinal"), *[F.col(f"m.{c}") for c in names],
        F.struct(*[F.col(f"q.{k}") for k in key_names]).alias("keys"), present.alias("found"))
    if on_missing == "error":
        message = F.concat(F.lit("no metadata for "), F.to_json("keys"))
        out = out.withColumn("found", F.when(F.assert_true("found", message).isNull(), F.lit(True)))
    return out.orderBy("ordinal")


def request_table(spark: SparkSession, key_names: Sequence[str], datasets: Sequence[Sequence[str]]) -> DataFrame:
    """A list of requested key tuples as a table."""
    schema = KeySchema(tuple(key_names))
    fields = [T.StructField("ordinal", T.IntegerType()), *(T.StructField(k, T.StringType()) for k in key_names)]
    return spark.createDataFrame([(i, *schema.every(keys)) for i, keys in enumerate(datasets)], T.StructType(fields))


def without_metadata(datasets: DataFrame, metadata: DataFrame, key_names: Sequence[str]) -> DataFrame:
    """Datasets whose statistics still have to be computed."""
    return datasets.join(metadata.select(*key_names), list(key_names), "left_anti")


def encode_metadata(decoded: DataFrame, key_names: Sequence[str]) -> DataFrame:
    """Nested form (bounds, range, percentiles, JSON-able structs) to the stored flat form."""
    def text(c):
        return F.col(c) if decoded.schema[c].dataType == T.StringType() else F.to_json(c)

    return decoded.select(
        *key_names,
        *[F.col(f"bounds.{c}").alias(c) for c in ("west", "south", "east", "north")],
        text("convex_hull").alias("convex_hull"), "valid_percentage",
        F.col("range.min").alias("min"), F.col("range.max").alias("max"), "mean", "stdev",
        F.col("percentiles").cast("array<float>").alias("percentiles"), text("metadata").alias("metadata"))


def decode_metadata(encoded: DataFrame, key_names: Sequence[str]) -> DataFrame:
    """Stored flat form to the nested form; JSON texts become variants."""
    return encoded.select(
        *key_names, F.struct("west", "south", "east", "north").alias("bounds"),
        F.parse_json("convex_hull").alias("convex_hull"), "valid_percentage",
        F.struct("min", "max").alias("range"), "mean", "stdev",
        F.col("percentiles").cast("array<double>").alias("percentiles"), F.parse_json("metadata").alias("metadata"))


# --- changes ----------------------------------------------------------------

def last_per_key(rows: DataFrame, key_names: Sequence[str], order: str) -> DataFrame:
    """Last row per key by ``order``, as a map-side combined aggregate."""
    rest = [c for c in rows.columns if c not in key_names]
    return rows.groupBy(*key_names).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*key_names, "_last.*")


def upsert(base: DataFrame, new: DataFrame, key_names: Sequence[str], order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``new`` replacing those of the same keys; last one wins inside ``new``."""
    if order is not None:
        new = last_per_key(new, key_names, order)
    return base.join(new.select(*key_names), list(key_names), "left_anti").unionByName(new.select(*base.columns))


def only_new(candidates: DataFrame, existing: DataFrame, key_names: Sequence[str]) -> DataFrame:
    return candidates.join(existing.select(*key_names), list(key_names), "left_anti")


def remove(base: DataFrame, gone: DataFrame, key_names: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*key_names), list(key_names), "left_anti")


def override_path(datasets: DataFrame, override_col: str = "override_path") -> DataFrame:
    """Store another path than the one the statistics were read from."""
    return datasets.withColumn("path", F.coalesce(F.col(override_col), F.col("path"))).drop(override_col)


def reorder_keys(key_names: DataFrame, order: Sequence[str]) -> DataFrame:
    """The key table with positions renumbered to ``order``."""
    position = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("key_name")) - 1
    return key_names.select("key_name", "description", position.cast("int").alias("idx"))


# --- old catalogs -----------------------------------------------------------

def upgrade_keys_0_7(keys: DataFrame, order: str | None = None) -> DataFrame:
    """Keys of a 0.7 catalog (key, description) numbered from 1.

    The old table has no position column; ``order`` names what to number by.
    The key table holds a handful of rows, so one task numbers them.
    """
    w = Window.orderBy(F.col(order) if order else F.lit(0))
    return keys.select(F.col("key").alias("key_name"), "description", F.row_number().over(w).alias("idx"))


def upgrade_datasets_0_7(datasets: DataFrame) -> DataFrame:
    return datasets.withColumnRenamed("filepath", "path")


WIDENED = ("bounds_north", "bounds_east", "bounds_south", "bounds_west",
           "valid_percentage", "min", "max", "mean", "stdev")


def upgrade_metadata_0_8(metadata: DataFrame) -> DataFrame:
    """Widen the statistics of a 0.8 catalog from float to double."""
    return metadata.withColumns({c: F.col(c).cast("double") for c in WIDENED if c in metadata.columns})


def rename_bounds(metadata: DataFrame) -> DataFrame:
    """Old catalogs store west, south, east, north under the names north, east, south, west."""
    return metadata.withColumnsRenamed({"bounds_north": "west", "bounds_east": "south",
                                        "bounds_south": "east", "bounds_west": "north"})


# --- the catalog as a whole -------------------------------------------------

@dataclass(frozen=True)
class Catalog:
    """The four tables. Every change returns a new catalog; nothing is computed until used."""

    key_names: DataFrame
    datasets: DataFrame
    metadata: DataFrame
    catalog_version: DataFrame

    @classmethod
    def create(cls, spark: SparkSession, keys: Sequence[str], descriptions: Mapping[str, str] | None = None) -> Catalog:
        key_names = keys_table(spark, keys, descriptions)
        key_fields = [T.StructField(k, T.StringType()) for k in keys]
        meta_ddl = ", ".join(f"`{c}` {t}" for c, t in METADATA_COLUMNS.items())
        meta_fields = T._parse_datatype_string(meta_ddl).fields
        return cls(
            key_names,
            spark.createDataFrame([], T.StructType(key_fields + [T.StructField("path", T.StringType())])),
            spark.createDataFrame([], T.StructType(key_fields + meta_fields)),
            spark.createDataFrame([(VERSION,)], "version STRING"))

    @property
    def keys(self) -> list[str]:
        """Key names in order, read from the schema, where they stand before ``path``."""
        return [c for c in self.datasets.columns if c != "path"]

    def check_version(self) -> Catalog:
        found = self.catalog_version.first()["version"]
        if found.split(".")[:2] != VERSION.split(".")[:2]:
            raise CatalogError(f"catalog version {found} does not match {VERSION}")
        return self

    def list_keys(self) -> DataFrame:
        return list_keys(self.key_names)

    def search(self, where=None, page: int = 0, limit: int | None = None) -> DataFrame:
        return page_of(search(self.datasets, self.keys, where), self.keys, page, limit)

    def metadata_of(self, keys, columns=None) -> DataFrame:
        """Metadata of one dataset; a dataset that the catalog does not hold is an error, looked up now."""
        full = KeySchema(tuple(self.keys)).every(keys)
        if search(self.datasets, self.keys, full).isEmpty():
            raise CatalogError(f"no dataset with the keys {full}")
        return metadata_columns(metadata_of(self.metadata, self.keys, keys), self.keys, columns)

    def metadata_batch(self, requests: DataFrame, columns=None, on_missing="error") -> DataFrame:
        return metadata_batch(requests, self.metadata, self.keys, columns, on_missing)

    def missing_metadata(self) -> DataFrame:
        return without_metadata(self.datasets, self.metadata, self.keys)

    def insert(self, datasets: DataFrame, metadata: DataFrame | None = None, order: str | None = None) -> Catalog:
        """Upsert datasets. Metadata of replaced datasets is dropped unless given anew, so it is never stale.

        Rows with the same keys are an error, found now, unless ``order`` tells which one is last.
        """
        if set(self.keys) - set(datasets.columns):
            raise CatalogError(f"datasets need the keys {self.keys}")
        if order is None and not duplicate_keys(datasets, self.keys).isEmpty():
            raise CatalogError("datasets with the same keys; name a column that tells which comes last")
        if metadata is not None:
            self._once(metadata)
        kept = remove(self.metadata, datasets, self.keys)
        new_meta = kept if metadata is None else upsert(kept, metadata, self.keys)
        return replace(self, datasets=upsert(self.datasets, datasets, self.keys, order), metadata=new_meta)

    def _once(self, metadata: DataFrame) -> None:
        """Two rows of one dataset would double its pixels in every join; found now."""
        if not duplicate_keys(metadata, self.keys).isEmpty():
            raise CatalogError("metadata rows with the same keys")

    def add_metadata(self, metadata: DataFrame) -> Catalog:
        self._once(metadata)
        return replace(self, metadata=upsert(self.metadata, metadata, self.keys))

    def delete(self, gone: DataFrame) -> Catalog:
        """Remove datasets by full key; fails now if one of them is absent."""
        if not only_new(gone, self.datasets, self.keys).isEmpty():
            raise CatalogError("no dataset with some of the given keys")
        return replace(self, datasets=remove(self.datasets, gone, self.keys),
                       metadata=remove(self.metadata, gone, self.keys))

    def with_last_key(self, key: str) -> Catalog:
        order = move_key_last(self.keys, key)
        rest = [c for c in self.metadata.columns if c not in order]
        return replace(self, key_names=reorder_keys(self.key_names, order),
                       datasets=self.datasets.select(*order, "path"), metadata=self.metadata.select(*order, *rest))
