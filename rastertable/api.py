"""One entry point per question a catalog answers; DataFrames in, DataFrames out.

A ``RasterService`` ties a catalog to its block table and grid headers. Image
requests take a table or list of tiles, or none for whole-dataset previews,
and are answered for all matching datasets in one job. Blocks are a table, with a ``level`` column if it holds overviews, or the path of a
table written by ``layout.write_blocks``, of which each request reads only the blocks under its tiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.operators import colormaps, layout, render, stats, tiles
from rastertable.operators.catalog import Catalog, CatalogError, request_table, search
from rastertable.operators.pyramid import levels_for_zoom, tile_layer_from_pyramid
from rastertable.operators.states import metadata_of_blocks
from rastertable.sources.cells import BLOCK_SIZE
from rastertable.sources.shared import checkpointed


@dataclass(frozen=True)
class RasterService:
    catalog: Catalog
    blocks: DataFrame | str      # keys, block_row, block_col, values; or a path
    grids: DataFrame             # keys and header
    block_size: int = BLOCK_SIZE
    reprojection: str = "linear"
    resampling: str = "average"
    tile_size: tuple[int, int] = tiles.TILE_SIZE

    @property
    def spark(self) -> SparkSession:
        return self.grids.sparkSession

    def keys(self) -> DataFrame:
        return self.catalog.list_keys()

    def datasets(self, where=None, page: int = 0, limit: int | None = None) -> DataFrame:
        return self.catalog.search(where, page, limit).select(*self.catalog.keys)

    def metadata(self, keys, columns: Sequence[str] | None = None) -> DataFrame:
        return self.catalog.metadata_of(keys, columns)

    def metadata_batch(self, requests: DataFrame | Sequence, columns: Sequence[str] | None = None) -> DataFrame:
        if not isinstance(requests, DataFrame):
            requests = request_table(self.spark, self.catalog.keys, requests)
        return self.catalog.metadata_batch(requests, columns)

    def colormap(self, stretch_range, colormap: str | None = None, num_values: int = 255) -> DataFrame:
        rows = None if colormap is None else colormaps.one_map(colormaps.builtin_colormaps(self.spark), colormap)
        return colormaps.color_bar(self.spark, stretch_range, rows, num_values)

    def with_missing_metadata(self, cells: DataFrame, max_shape: Sequence[int] | None = None) -> RasterService:
        """Compute statistics for datasets that have none yet, from all pixels unless ``max_shape`` decimates."""
        filled = stats.fill_missing(self.catalog.datasets, self.catalog.metadata, cells, self.grids, self.catalog.keys, max_shape)
        return replace(self, catalog=replace(self.catalog, metadata=filled))

    def _base_blocks(self) -> DataFrame:
        if isinstance(self.blocks, str):
            return layout.read_blocks(self.spark, self.blocks)
        return self.blocks.where("level = 0").drop("level") if "level" in self.blocks.columns else self.blocks

    def _found(self, where) -> DataFrame:
        """Keys of the datasets asked for; none at all is an error, and so is a key value of a list that no dataset has."""
        keys = self.catalog.keys
        chosen = search(self.catalog.datasets, keys, where).select(*keys)
        if chosen.isEmpty():
            raise CatalogError(f"no dataset with {where}")
        return chosen

    def _statistics(self, chosen: DataFrame, stretch_range) -> DataFrame:
        """Metadata of the chosen datasets; where it is needed and missing, it is computed from their blocks now."""
        known = self.catalog.metadata
        if stretch_range is not None and all(isinstance(v, (int, float)) for v in stretch_range):
            return known
        missing = checkpointed(chosen.join(known.select(*self.catalog.keys), self.catalog.keys, "left_anti"))
        if missing.isEmpty():
            return known
        own = lambda df: df.join(missing, self.catalog.keys, "left_semi")
        made = metadata_of_blocks(own(self._base_blocks()), own(self._grids()), self.catalog.keys, size=self.block_size)
        return known.unionByName(checkpointed(made).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known.schema]))

    def _grids(self) -> DataFrame:
        """Headers for the blocks at hand: stored ones are masked already."""
        return self.grids.drop("nodata", "has_alpha") if isinstance(self.blocks, str) else self.grids

    def _layer(self, grids: DataFrame, zoom: int, size, wanted: DataFrame, options: dict) -> DataFrame:
        keys = self.catalog.keys
        if not isinstance(self.blocks, str):
            layer = tile_layer_from_pyramid if "level" in self.blocks.columns else (lambda b, g, k, z, s, **o: tiles.tile_layer(b, g, k, (z,), s, **o))
            return layer(self.blocks, grids, keys, zoom, size, tiles=wanted, **options)
        out, reach = None, {"nearest": 0, "linear": 1, "cubic": 2}[self.reprojection]
        for level, some in levels_for_zoom(grids, keys, zoom, size, self.block_size).items():
            frames = tiles.tile_frames(some, keys, (zoom,), size, tiles=wanted)
            blocks = layout.read_for_frames(self.spark, self.blocks, frames, keys, tiles.TILE_IDS, level, reach, self.block_size)
            part = tiles.tile_layer(blocks, some, keys, (zoom,), size, tiles=wanted, **options)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else tiles.tile_layer(self._base_blocks(), grids, keys, (zoom,), size, tiles=wanted, **options)

    def _tile_table(self, wanted) -> DataFrame:
        if isinstance(wanted, DataFrame):
            return wanted
        fields = [T.StructField("z", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]
        return self.spark.createDataFrame([(int(z), int(x), int(y)) for x, y, z in wanted], T.StructType(fields))

    def pixels(self, where=None, tile_xyz=None, *, preserve_values: bool = False, tile_size=None) -> tuple[DataFrame, list[str]]:
        """Tile or preview pixels of the datasets found by ``where``, and the position columns.

        ``tile_xyz``: (x, y, z) tuples, or a table with z, x, y for long lists.
        """
        keys = self.catalog.keys
        size = tile_size or self.tile_size
        grids = self._grids().join(self._found(where), keys, "left_semi")
        options = dict(reprojection=self.reprojection, resampling=self.resampling,
                       preserve_values=preserve_values, block_size=self.block_size)
        if tile_xyz is None:
            return tiles.previews(self._base_blocks(), grids, keys, size, **options), ["py", "px"]
        wanted = self._tile_table(tile_xyz)
        zooms = [r["z"] for r in wanted.select("z").distinct().collect()]  # a handful of zoom levels
        bounds = stats.geographic_bounds(grids, keys)
        per_dataset = tiles.tiles_with_datasets(wanted, bounds, keys, zooms)
        layers = [self._layer(grids, zoom, size, per_dataset, options) for zoom in sorted(zooms)]
        layer = layers[0]
        for more in layers[1:]:
            layer = layer.unionByName(more)
        return layer, [*tiles.TILE_IDS, "py", "px"]

    def _completed(self, rendered: DataFrame, images: DataFrame, tile_xyz, tile_size) -> DataFrame:
        """All pixels of every image asked for: each dataset (or scene) in each tile, also where it does not reach."""
        if tile_xyz is not None:
            images = images.crossJoin(F.broadcast(self._tile_table(tile_xyz).distinct()))  # the request itself
        return tiles.complete_images(images, rendered, tile_size or self.tile_size)

    def singleband(self, where=None, tile_xyz=None, *, colormap: str | Mapping | None = None, stretch_range=None,
                   color_transform=(), tile_size=None, complete: bool = False) -> DataFrame:
        """Coloured pixels. Statistics that are missing are computed on the way. ``complete`` adds the transparent pixels of every image asked for."""
        pixels, at = self.pixels(where, tile_xyz, preserve_values=isinstance(colormap, Mapping), tile_size=tile_size)
        labelled = isinstance(colormap, Mapping)
        metadata = self.catalog.metadata if labelled else self._statistics(self._found(where), stretch_range)
        out = render.singleband(pixels, metadata, self.catalog.keys, stretch_range=stretch_range,
                                colormap=colormap, color_transform=color_transform, at=at)
        return self._completed(out, self._found(where), tile_xyz, tile_size) if complete else out

    def _scene(self, some_keys, last_values) -> dict:
        *other, last = self.catalog.keys
        if len(some_keys) != len(other):
            raise CatalogError("give all keys except the last one")
        named = dict(some_keys) if isinstance(some_keys, Mapping) else dict(zip(other, some_keys))
        return {**named, last: sorted(set(last_values))}

    def rgb(self, some_keys, rgb_values: Sequence[str], tile_xyz=None, *, stretch_ranges=None,
            color_transform=(), tile_size=None, complete: bool = False) -> DataFrame:
        scene = self._scene(some_keys, rgb_values)
        pixels, at = self.pixels(scene, tile_xyz, tile_size=tile_size)
        given = stretch_ranges is not None and all(r is not None and all(isinstance(v, (int, float)) for v in r) for r in stretch_ranges)
        metadata = self._statistics(self._bands(scene), (0, 1) if given else None)
        out = render.rgb(pixels, metadata, self.catalog.keys, rgb_values,
                         stretch_ranges=stretch_ranges, color_transform=color_transform, at=at)
        return self._completed(out, self._bands(scene).select(*self.catalog.keys[:-1]).distinct(), tile_xyz, tile_size) if complete else out

    def _bands(self, scene: dict) -> DataFrame:
        """Datasets of a scene; a band that no dataset has is an error."""
        chosen, last = self._found(scene), self.catalog.keys[-1]
        absent = set(scene[last]) - {r[0] for r in chosen.select(last).distinct().limit(len(scene[last])).collect()}
        if absent:
            raise CatalogError(f"no dataset with {last} {sorted(absent)}")
        return chosen

    def compute(self, expression, some_keys, operands: Mapping[str, str], stretch_range, tile_xyz=None, *,
                colormap: str | None = None, tile_size=None, complete: bool = False) -> DataFrame:
        scene = self._scene(some_keys, operands.values())
        bands = self._bands(scene)
        pixels, at = self.pixels(scene, tile_xyz, tile_size=tile_size)
        out = render.compute(pixels, self.catalog.keys, operands, expression, stretch_range, colormap=colormap, at=at)
        return self._completed(out, bands.select(*self.catalog.keys[:-1]).distinct(), tile_xyz, tile_size) if complete else out
