"""Overview pyramids and the tiled storage layout.

Each level halves the one before. For averages, sums and counts are carried
instead of means, so level n equals the average over all its base pixels even
with masks; for nearest, every level is a filter on the base cells and moves
nothing at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.operators.stats import located_grids, masked_cells
from rastertable.operators.tiles import MIN_WEIGHT, TILE_SIZE, cubic_weight, linear_weight, tile_layer
from rastertable.sources.cells import BLOCK_SIZE, pack_blocks
from rastertable.sources.shared import checkpointed

METHODS = ("average", "nearest", "bilinear", "cubic")
LARGE_SIDE = 512  # fixed value: rasters above this on both sides should be tiled and have overviews


def with_levels(grids: DataFrame, block: int = BLOCK_SIZE) -> DataFrame:
    """Adds ``levels``: the number of overviews, factors 2, 4, ... 2^levels."""
    blocks = F.greatest(F.floor(F.col("height") / block), F.floor(F.col("width") / block), F.lit(1).cast("long"))
    # smallest n with 2^n >= blocks, in whole numbers
    return grids.withColumn("levels", F.length(F.bin(blocks - 1)) - F.when(blocks == 1, F.lit(1)).otherwise(F.lit(0)))


def level_grids(grids: DataFrame, level: int) -> DataFrame:
    """Headers of one overview level: half the pixels per level, the same origin."""
    f = 1 << level
    up = lambda n: F.ceil(F.col(n) / f).cast("int")
    return grids.withColumns({"width": up("width"), "height": up("height"),
                              **{n: F.col(n) * f for n in "abde"}})


def _factor():
    return F.call_function("shiftleft", F.lit(1), F.col("level"))


def _half(c: str):
    return F.shiftright(F.col(c), 1)


def pyramid(cells: DataFrame, grids: DataFrame, keys, method: str = "average", block: int = BLOCK_SIZE) -> DataFrame:
    """Overview cells of all datasets: keys, level (1..), row, col, value; masked cells are left out.

    Masked are the grid's nodata value, pixels without alpha, and non-finite
    values. Every level is kept in the shared folder, so the base is read once
    whatever the depth.
    """
    keys = list(keys)
    if method not in METHODS:
        raise ValueError(f"unknown overview method {method!r}, choose from {METHODS}")
    deep = with_levels(grids, block).select(*keys, "levels", F.col("height").alias("_h"), F.col("width").alias("_w"))
    base = (masked_cells(cells, grids, keys).where("value IS NOT NULL")
            .join(deep, keys).where("levels > 0"))
    if method == "nearest":
        return _nearest_levels(base, keys)
    top = deep.agg(F.max("levels")).first()[0] or 0  # a number per catalog, at most about 20
    step = {"average": _average_step, "bilinear": _kernel_step(linear_weight, 1),
            "cubic": _kernel_step(cubic_weight, 2)}[method]
    state = base.select(*keys, "levels", "_h", "_w", "row", "col",
                        F.col("value").alias("_s"), F.lit(1.0).alias("_n"))
    out = None
    for level in range(1, top + 1):
        state = checkpointed(step(state.where(F.col("levels") >= level), keys))
        rows = state.select(*keys, F.lit(level).alias("level"), "row", "col", (F.col("_s") / F.col("_n")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return _nearest_levels(base.limit(0), keys)
    return out


def _nearest_levels(base: DataFrame, keys) -> DataFrame:
    factor = _factor()
    return (base.withColumn("level", F.explode(F.sequence(F.lit(1), "levels")))
            .where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))
            .select(*keys, "level", F.call_function("shiftright", F.col("row"), F.col("level")).alias("row"),
                    F.call_function("shiftright", F.col("col"), F.col("level")).alias("col"), "value"))


def _average_step(state: DataFrame, keys) -> DataFrame:
    return state.groupBy(*keys, "levels", "_h", "_w", _half("row").alias("row"), _half("col").alias("col")).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))


def _kernel_step(weight, radius: int):
    """Halve with a kernel stretched to the coarser grid; masked pixels drop out of the weights."""
    def step(state: DataFrame, keys) -> DataFrame:
        half_h = F.call_function("div", F.col("_h") + 1, F.lit(2)).cast("int")
        half_w = F.call_function("div", F.col("_w") + 1, F.lit(2)).cast("int")
        near = lambda c, n: F.explode(F.sequence(
            F.greatest(F.ceil((F.col(c) + 0.5) / 2 - 0.5 - radius).cast("int"), F.lit(0)),
            F.least(F.floor((F.col(c) + 0.5) / 2 - 0.5 + radius).cast("int"), n - 1)))
        spread = (state.withColumns({"_nh": half_h, "_nw": half_w, "_v": F.col("_s") / F.col("_n")})
                  .withColumn("_r", near("row", F.col("_nh"))).withColumn("_c", near("col", F.col("_nw"))))
        dist = lambda c, t: (F.col(c) + 0.5) / 2 - 0.5 - F.col(t)
        w = weight(dist("row", "_r")) * weight(dist("col", "_c"))
        summed = spread.groupBy(*keys, "levels", F.col("_nh").alias("_h"), F.col("_nw").alias("_w"),
                                F.col("_r").alias("row"), F.col("_c").alias("col")).agg(
            F.sum(w * F.col("_v")).alias("_s"), F.sum(w).alias("_n"))
        return summed.where(F.abs("_n") > MIN_WEIGHT)
    return step


# --- storage layout -----------------------------------------------------------

def tiled_blocks(cells: DataFrame, keys, size: int = BLOCK_SIZE) -> DataFrame:
    """Block rows of base cells (no ``level`` column: level 0) or of a pyramid."""
    if "level" not in cells.columns:
        cells = cells.withColumn("level", F.lit(0))
    return pack_blocks(cells, [*keys, "level"], size)


def write_tiled(cells: DataFrame, keys, path: str, size: int = BLOCK_SIZE, mode: str = "errorifexists") -> None:
    """Write blocks clustered by dataset and position, one folder per level, so that
    reading one level or one region prunes by folder and by Parquet statistics."""
    if mode not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown write mode {mode!r}")
    order = ["level", *keys, "block_row", "block_col"]
    (tiled_blocks(cells, keys, size).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.partitionBy("level").parquet(path, mode=mode, compression="zstd"))


def read_tiled(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    blocks = spark.read.parquet(path)
    return blocks if level is None else blocks.where(F.col("level") == level).drop("level")


def write_pyramid(cells: DataFrame, grids: DataFrame, keys, path: str, method: str = "average",
                  size: int = BLOCK_SIZE, mode: str = "errorifexists") -> None:
    """Base level and overviews in one tiled table."""
    base = masked_cells(cells, grids, keys).select(*keys, F.lit(0).alias("level"), "row", "col", F.col("value").cast("double").alias("value"))
    write_tiled(base.unionByName(pyramid(cells, grids, keys, method, size)), keys, path, size, mode)


def layout_audit(blocks: DataFrame, grids: DataFrame, keys, size: int = BLOCK_SIZE) -> DataFrame:
    """Is every raster above LARGE_SIDE tiled, with all its overviews?

    One row per grid: ``errors`` and ``warnings`` (arrays of text) and
    ``valid``, true without either. Fully masked blocks are not stored, so a
    level counts as present when it has at least one block and no block lies
    outside its grid.
    """
    keys = list(keys)
    levelled = with_levels(grids, size).select(*keys, "width", "height", "levels")
    per_level = blocks.groupBy(*keys, "level").agg(
        F.max("block_row").alias("_br"), F.max("block_col").alias("_bc"), F.min("level").alias("_low"))
    found = per_level.join(levelled, keys).select(
        *keys, "level",
        ((F.col("_br") * size * _factor() >= F.col("height"))
         | (F.col("_bc") * size * _factor() >= F.col("width"))).alias("_outside"))
    have = found.groupBy(*keys).agg(
        F.array_sort(F.collect_set("level")).alias("_found"), F.max("_outside").alias("_outside"))
    large = (F.col("width") > LARGE_SIDE) & (F.col("height") > LARGE_SIDE)
    expected = F.when(F.col("levels") > 0, F.sequence(F.lit(1), F.greatest("levels", F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    got = F.coalesce("_found", F.array().cast("array<int>"))
    missing = F.array_except(expected, got)
    messages = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))
    return levelled.join(have, keys, "left").withColumns({
        "errors": messages(
            (large & ~F.array_contains(got, 0), "large raster without base blocks"),
            (F.coalesce("_outside", F.lit(False)), "blocks outside the raster"),
            (F.exists(got, lambda v: v < 0), "decimation not above 1")),
        "warnings": messages((large & (F.size(missing) > 0), "overviews missing")),
    }).withColumn("valid", (F.size("errors") == 0) & (F.size("warnings") == 0)).select(*keys, "errors", "warnings", "valid")


# --- tiles out of a pyramid ----------------------------------------------------

def levels_for_zoom(grids: DataFrame, keys, zoom: int, tile_size=TILE_SIZE, block_size: int = BLOCK_SIZE, crs: str | None = None) -> dict[int, DataFrame]:
    """Grids by the coarsest level that is still as fine as the tiles of a zoom, as headers of that level."""
    keys = list(keys)
    tile_res = geo.CIRCUMFERENCE / 2**zoom / max(int(v) for v in tile_size)
    located = located_grids(grids, keys, crs)
    fit = F.floor(F.log2(F.lit(tile_res) / F.col("res"))).cast("int")
    chosen = with_levels(located, block_size).select(*keys, F.greatest(F.least(fit, F.col("levels")), F.lit(0)).alias("_level"))
    levelled = grids.join(chosen, keys)
    found = sorted(r[0] for r in levelled.select("_level").distinct().collect())  # about 20 at most
    return {level: level_grids(levelled.where(F.col("_level") == level).drop("_level"), level) for level in found}


def tile_layer_from_pyramid(blocks: DataFrame, grids: DataFrame, keys, zoom: int, tile_size=TILE_SIZE,
                            block_size: int = BLOCK_SIZE, crs: str | None = None, **options) -> DataFrame:
    """Tiles of one zoom level, each dataset read at the coarsest stored level that is still as fine as the tile.

    ``blocks`` has a ``level`` column, 0 being the base. A low zoom then reads
    a few overview blocks instead of all base pixels. Levels are literals, so
    other level folders are not read. Where sizes are odd, the last overview
    pixels reach past the raster by a part of a pixel.
    """
    keys, parts = list(keys), []
    for level, some in levels_for_zoom(grids, keys, zoom, tile_size, block_size, crs).items():
        at_level = blocks.where(F.col("level") == level).drop("level")
        parts.append(tile_layer(at_level, some, keys, (zoom,), tile_size, crs=crs, block_size=block_size, **options))
    if not parts:
        return tile_layer(blocks.where(F.col("level") == 0).drop("level"), grids, keys, (zoom,), tile_size,
                          crs=crs, block_size=block_size, **options)
    return reduce(lambda a, b: a.unionByName(b), parts)
