"""Ingest of a collection: paths to keys, statistics, catalog rows, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.operators.catalog import Catalog, CatalogError, only_new
from rastertable.operators.states import metadata_of_blocks
from rastertable.operators.stats import compute_metadata
from rastertable.sources import paths as path_keys
from rastertable.sources.shared import checkpointed
from rastertable.sources.store import CatalogStore


def datasets_from_paths(paths: DataFrame, pattern: str, rgb_key: str | None = None, check: bool = True) -> DataFrame:
    """Datasets named by a path pattern; ``rgb_key`` becomes the last key."""
    keys = list(path_keys.parse_pattern(pattern).keys)
    found = path_keys.keys_from_paths(paths, pattern)
    if check:
        path_keys.require_unique(found, keys)
    if rgb_key is not None:
        keys = path_keys.move_key_last(keys, rgb_key)
    return found.select(*keys, "path")


def keyed_rasters(datasets: DataFrame, rasters: DataFrame) -> DataFrame:
    """Cells or grids known by path, addressed by keys instead."""
    return datasets.join(rasters, "path").drop("path")


def ingest(catalog: Catalog, datasets: DataFrame, cells: DataFrame | None = None, grids: DataFrame | None = None, *,
           blocks: DataFrame | None = None, skip_metadata: bool = False, skip_existing: bool = False, override_paths: DataFrame | None = None,
           extra: DataFrame | None = None, **stats_options) -> Catalog:
    """Upsert ``datasets`` (keys, path) with the statistics of their rasters.

    ``cells`` (or stored ``blocks``, whose pixels are read once or twice in all) and ``grids`` carry a ``path`` column. The keys must be those of
    the catalog, in name and order. With statistics, datasets without a valid
    pixel are not inserted. ``override_paths`` (path, override_path) stores
    another path than the one read.
    """
    keys = [c for c in datasets.columns if c != "path"]
    if keys != catalog.keys:
        raise CatalogError(f"catalog has the keys {catalog.keys}, not {keys}")
    if skip_existing:
        datasets = only_new(datasets, catalog.datasets, keys)
    metadata = None
    if not skip_metadata:
        pixels, compute = (cells, compute_metadata) if blocks is None else (blocks, metadata_of_blocks)
        metadata = compute(keyed_rasters(datasets, pixels), keyed_rasters(datasets, grids), keys, extra=extra, **stats_options)
        metadata = checkpointed(metadata)  # one row per dataset, used several times from here on
        datasets = datasets.join(metadata.select(*keys), keys, "left_semi")
    if override_paths is not None:
        datasets = (datasets.join(override_paths, "path", "left")
                    .withColumn("path", F.coalesce("override_path", "path")).select(*keys, "path"))
    return catalog.insert(datasets, metadata)


def ingest_into(spark: SparkSession, root: str, datasets: DataFrame, *args, **options) -> Catalog:
    """Ingest into the catalog stored at ``root``, created if it is not there."""
    store = CatalogStore(spark, root)
    keys = [c for c in datasets.columns if c != "path"]
    catalog = store.load() if store.exists() else Catalog.create(spark, keys)
    return store.save(ingest(catalog, datasets, *args, **options))
