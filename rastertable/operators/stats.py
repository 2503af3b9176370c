"""Per-dataset statistics of a whole catalog in one job.

Moments combine on the map side, so a dataset holding a third of all pixels
costs no more than its share of the scan. ``stdev`` is the population form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.functions.masks import finite, read_mask
from rastertable.operators import hull as hulls
from rastertable.operators import percentiles as pct
from rastertable.operators.crs import per_crs
from rastertable.sources.shared import checkpointed

# fixed values
EDGE_POINTS = 21    # points added per edge when a box is projected


def masked_cells(cells: DataFrame, grids: DataFrame, keys) -> DataFrame:
    """Apply each grid's nodata value, the alpha column where the grid has alpha, and the finite rule."""
    alpha = "alpha" if "alpha" in cells.columns else None
    has_alpha = F.coalesce("has_alpha", F.lit(False)) if "has_alpha" in grids.columns else F.lit(True)
    nodata = F.col("nodata") if "nodata" in grids.columns else F.lit(None).cast("double")
    joined = cells.join(grids.select(*keys, nodata.alias("_nodata"), has_alpha.alias("_has_alpha")), list(keys))
    return joined.withColumn("value", read_mask("value", "_nodata", alpha, "_has_alpha")).drop("_nodata", "_has_alpha")


def unmasked_audit(grids: DataFrame, keys) -> DataFrame:
    """Datasets without a nodata value and without alpha: nothing in them can be masked."""
    return grids.select(*keys, (F.col("nodata").isNull() & ~F.col("has_alpha")).alias("unmasked"))


def _moments(value="value") -> list[Column]:
    v = finite(value).cast("double")
    return [F.count(v).alias("n_valid"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev")]


def moments(cells: DataFrame, keys, value="value") -> DataFrame:
    return cells.groupBy(*keys).agg(*_moments(value))


def _with_share(stats: DataFrame, grids: DataFrame, keys) -> DataFrame:
    """Add the valid percentage: totals come from the grid, as cells may be sparse."""
    total = (F.col("width").cast("long") * F.col("height")).cast("double")
    return (grids.select(*keys, total.alias("_total")).join(stats, list(keys), "left")
            .withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("long")))
            .withColumn("valid_percentage", F.col("n_valid") / F.col("_total") * 100).drop("_total"))


def dataset_stats(cells: DataFrame, grids: DataFrame, keys, percentiles: str = "exact") -> DataFrame:
    """One row per grid: n_valid, min, max, mean, stdev, percentiles, valid_percentage, percentile_method.

    ``percentiles`` is ``exact`` (rank selection, at every size), ``approx``
    (sketches, on demand only) or ``none``.
    """
    keys = list(keys)
    if percentiles not in ("none", "exact", "approx"):
        raise ValueError(f"unknown percentile method {percentiles!r}")
    if percentiles == "none":
        return _with_share(moments(cells, keys), grids, keys)
    if percentiles == "approx":
        sketch = pct.approx_percentiles(finite("value").cast("double"))
        stats = cells.groupBy(*keys).agg(*_moments(), sketch.alias("percentiles"))
    else:
        stats = moments(cells, keys).join(pct.exact_percentiles(cells, keys), keys, "left")
    return _with_share(stats.withColumn("percentile_method", F.lit(percentiles)), grids, keys)


def split_empty(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected datasets without any valid pixel."""
    return stats.where("n_valid > 0"), stats.where("n_valid = 0")


# --- decimated --------------------------------------------------------------

def _kept_rank(i: Column, size: Column, out: Column) -> Column:
    """Output position that reads source row ``i`` (nearest centre), or NULL if none does.

    Position k reads source row floor((k + 1/2) * size / out), in whole numbers.
    """
    i, size, out = (c.cast("long") for c in (i, size, out))
    div = lambda a, b: F.call_function("div", a, b)
    k = div(F.greatest(2 * i * out - size, F.lit(0).cast("long")) + 2 * size - 1, 2 * size)
    return F.when((div((2 * k + 1) * size, 2 * out) == i) & (k < out), k)


def decimate(cells: DataFrame, grids: DataFrame, keys, max_shape: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Cells and grids cut to at most ``max_shape`` (rows, columns); each axis on its own."""
    keys = list(keys)
    if len(max_shape) != 2:
        raise ValueError("max_shape needs two values")
    rows, cols = (int(x) for x in max_shape)
    cut = grids.select(
        *grids.columns,
        F.least(F.col("height"), F.lit(rows)).cast("int").alias("_h"),
        F.least(F.col("width"), F.lit(cols)).cast("int").alias("_w"))
    joined = cells.join(cut.select(*keys, F.col("height").alias("_rows"), F.col("width").alias("_cols"), "_h", "_w"), keys)
    thin = (
        joined.withColumn("row", _kept_rank(F.col("row"), F.col("_rows"), F.col("_h")).cast("int"))
        .withColumn("col", _kept_rank(F.col("col"), F.col("_cols"), F.col("_w")).cast("int"))
        .where("row IS NOT NULL AND col IS NOT NULL").drop("_rows", "_cols", "_h", "_w"))
    # same box, larger pixels
    sx, sy = F.col("width") / F.col("_w"), F.col("height") / F.col("_h")
    scaled = {"a": F.col("a") * sx, "d": F.col("d") * sx, "b": F.col("b") * sy, "e": F.col("e") * sy}
    thin_grids = cut.withColumns({n: c for n, c in scaled.items() if n in grids.columns}).withColumns(
        {"height": F.col("_h"), "width": F.col("_w")}).drop("_h", "_w")
    return thin, thin_grids


# --- mergeable states -------------------------------------------------------

def block_states(cells: DataFrame, keys, size: int = 256, sketch: bool = False, masked: bool = False) -> DataFrame:
    """One mergeable state per block: count, min, max, mean and the squared deviations from it.

    ``sketch`` adds a quantile sketch; sketches are randomised, so equal input
    gives equal results only within their error. ``masked`` keeps blocks without any valid pixel, with a count of 0.
    """
    v = finite("value").cast("double")
    more = [F.kll_sketch_agg_double(v).alias("sketch")] if sketch else []
    states = cells.groupBy(
        *keys, F.floor(F.col("row") / size).cast("int").alias("block_row"),
        F.floor(F.col("col") / size).cast("int").alias("block_col"),
    ).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
          (F.var_pop(v) * F.count(v)).alias("m2"), *more)
    return states if masked else states.where("n > 0")


def merge_states(states: DataFrame, keys) -> DataFrame:
    """Merge block states: refreshing one block needs only that block's pixels again.

    States, one row per block, are kept in the shared folder, so what makes them runs once.
    """
    keys, states = list(keys), checkpointed(states.where("n > 0"))
    total = states.groupBy(*keys).agg(
        F.sum("n").alias("n_valid"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    spread = (states.join(total.select(*keys, F.col("mean").alias("_mean")), keys)
              .groupBy(*keys).agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0)))
                                  .alias("_m2")))
    return total.join(spread, keys).withColumn("stdev", F.sqrt(F.col("_m2") / F.col("n_valid"))).drop("_m2")


# --- bounds -----------------------------------------------------------------

def corner_box(grids: DataFrame, keys) -> DataFrame:
    """Box of every grid in its own CRS."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    xs, ys = zip(*[geo.pixel_to_xy(c, r) for c, r in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (F.lit(0.0), h), (w, h))])
    return grids.withColumns({"left": F.least(*xs), "bottom": F.least(*ys), "right": F.greatest(*xs), "top": F.greatest(*ys)})


def box_edges(boxes: DataFrame) -> DataFrame:
    """Points along the edges of left/bottom/right/top, corners included: _e, _i, _x, _y."""
    t = F.col("_i").cast("double") / F.lit(float(EDGE_POINTS + 1))
    along_x = F.col("left") + (F.col("right") - F.col("left")) * t
    along_y = F.col("bottom") + (F.col("top") - F.col("bottom")) * t
    x = F.when(F.col("_e") < 2, along_x).when(F.col("_e") == 2, F.col("left")).otherwise(F.col("right"))
    y = F.when(F.col("_e") >= 2, along_y).when(F.col("_e") == 0, F.col("bottom")).otherwise(F.col("top"))
    return (boxes.withColumn("_e", F.explode(F.array(*[F.lit(i) for i in range(4)])))
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(EDGE_POINTS + 1))))
            .withColumns({"_x": x, "_y": y}))


def located_grids(grids: DataFrame, keys, crs: str | None = None) -> DataFrame:
    """Grids with west, south, east, north (degrees), ml, mb, mr, mt (Web Mercator box)
    and ``res``, the Web Mercator resolution that keeps the pixel diagonal.

    Between degrees and Web Mercator a box stays a box, so its corners tell
    all. UTM boxes are bent: their edges are sampled and the extremes kept.
    """
    keys = list(keys)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    pixel_diagonal = F.sqrt(w * w + h * h)
    first, last = geo.pixel_to_xy(F.lit(0.0), F.lit(0.0)), geo.pixel_to_xy(w, h)

    def straight(some, kind):
        low, high = (F.col("left"), F.col("bottom")), (F.col("right"), F.col("top"))
        (west, south), (east, north) = (geo.separable_lonlat(kind, *p) for p in (low, high))
        (ml, mb), (mr, mt) = (geo.separable_mercator(kind, *p) for p in (low, high))
        (x0, y0), (x1, y1) = (geo.separable_mercator(kind, *p) for p in (first, last))
        res = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / pixel_diagonal
        return corner_box(some, keys).withColumns({
            "west": west, "south": south, "east": east, "north": north,
            "ml": ml, "mb": mb, "mr": mr, "mt": mt, "res": res}).drop("left", "bottom", "right", "top")

    def bent(some, kind):
        header = F.struct(*[c for c in some.columns if c not in keys])
        boxed = corner_box(some, keys).withColumn("_grid", header)
        ends = boxed.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
            "_x": F.when(F.col("_end") == 0, first[0]).otherwise(last[0]),
            "_y": F.when(F.col("_end") == 0, first[1]).otherwise(last[1])})
        columns = [*keys, "_grid", "crs", "_end", "_x", "_y"]
        points = box_edges(boxed).withColumn("_end", F.lit(None).cast("int")).select(columns).unionByName(ends.select(columns))
        placed = geo.project(points, kind, geo.WGS84, F.col("_x"), F.col("_y"), "lon_", "lat_")
        mx, my = geo.separable_mercator(geo.WGS84, F.col("lon_"), F.col("lat_"))
        placed = placed.withColumns({"_mx": mx, "_my": my})
        at = lambda c, end: F.max(F.when(F.col("_end") == end, F.col(c)))
        dx, dy = at("_mx", 1) - at("_mx", 0), at("_my", 1) - at("_my", 0)
        summed = placed.groupBy(*keys).agg(
            F.first("_grid").alias("_grid"), F.min("lon_").alias("west"), F.min("lat_").alias("south"),
            F.max("lon_").alias("east"), F.max("lat_").alias("north"), F.min("_mx").alias("ml"), F.min("_my").alias("mb"),
            F.max("_mx").alias("mr"), F.max("_my").alias("mt"), F.sqrt(dx * dx + dy * dy).alias("_d"))
        out = summed.select(*keys, "_grid.*", *[c for c in summed.columns if c not in (*keys, "_grid")])
        return out.withColumn("res", F.col("_d") / pixel_diagonal).drop("_d")

    return per_crs(grids, lambda some, kind: (straight if kind in geo.SEPARABLE else bent)(some, kind), crs)


def geographic_bounds(grids: DataFrame, keys, crs: str | None = None) -> DataFrame:
    """west, south, east, north of every grid in degrees."""
    return located_grids(grids, keys, crs).select(*keys, "west", "south", "east", "north")


# --- everything -------------------------------------------------------------

def compute_metadata(cells: DataFrame, grids: DataFrame, keys, *, percentiles: str = "exact",
                     use_chunks: bool | None = None, max_shape: Sequence[int] | None = None,
                     extra: DataFrame | None = None) -> DataFrame:
    """Metadata rows for all datasets with valid pixels.

    ``use_chunks`` true asks for sketched percentiles, false for exact ones;
    it excludes ``max_shape``, which decimates first (the bounds stay those of
    the full grid). ``extra`` carries keys and a ``metadata`` JSON column.
    """
    keys = list(keys)
    if use_chunks and max_shape is not None:
        raise ValueError("use_chunks and max_shape exclude each other")
    if use_chunks:
        percentiles = "approx"
    bounds = geographic_bounds(grids, keys)
    valid = masked_cells(cells, grids, keys)
    if max_shape is not None:
        valid, grids = decimate(valid, grids, keys, max_shape)
    stats, _ = split_empty(dataset_stats(valid, grids, keys, percentiles))
    hull = hulls.convex_hull(valid, grids, keys)
    out = stats.join(bounds, keys).join(hull, keys)
    if extra is not None:
        out = out.join(extra.select(*keys, "metadata"), keys, "left")
    else:
        out = out.withColumn("metadata", F.lit(None).cast("string"))
    return out.select(
        *keys, "west", "south", "east", "north", "convex_hull", "valid_percentage", "min", "max", "mean", "stdev",
        F.col("percentiles").cast("array<float>").alias("percentiles"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def fill_missing(datasets: DataFrame, metadata: DataFrame, cells: DataFrame, grids: DataFrame, keys,
                 max_shape: Sequence[int] | None = None) -> DataFrame:
    """Metadata plus rows for the datasets lacking them, computed from all pixels unless ``max_shape`` decimates."""
    keys = list(keys)
    missing = datasets.join(metadata.select(*keys), keys, "left_anti").select(*keys)
    todo_grids = grids.join(missing, keys, "left_semi")
    todo_cells = cells.join(missing, keys, "left_semi")
    return metadata.unionByName(compute_metadata(todo_cells, todo_grids, keys, max_shape=max_shape))
