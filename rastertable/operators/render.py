"""Pixels to colours: single bands, RGB composites, computed bands.

Input pixels are any table with the keys, position columns (``at``) and
``value``: cells, overview cells or tile pixels. Output keeps the positions
and adds ``index`` (0..255, 0 transparent) or the bands, and r, g, b, a.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.functions.algebra import evaluate
from rastertable.functions.color import contrast_stretch, grey, label, rgb_alpha, stretch_bound, to_uint8
from rastertable.operators import colormaps as cmaps
from rastertable.operators.bands import PIXEL, align_bands
from rastertable.operators.transforms import Transform, apply_transforms

STATS = ("min", "max", "percentiles")


def _range(stretch_range, percentile_base, prefix="") -> tuple[Column, Column]:
    lo, hi = stretch_range if stretch_range is not None else (None, None)
    p = f"{prefix}percentiles"
    return (stretch_bound(lo, p, f"{prefix}min", percentile_base),
            stretch_bound(hi, p, f"{prefix}max", percentile_base))


def _colored(pixels: DataFrame, rows: DataFrame | None) -> DataFrame:
    if rows is not None:
        return cmaps.apply_map(pixels, rows)
    return pixels.withColumn("_g", grey("index")).select("*", *[F.col(f"_g.{c}").alias(c) for c in "rgba"]).drop("_g")


def _must_know(joined: DataFrame, known: Column, keys) -> DataFrame:
    """Fails the job at a pixel whose dataset has no statistics; no layer is left out for the lack of them."""
    name = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    message = F.concat(F.lit("no statistics to stretch by: "), name)
    return joined.where(F.assert_true(F.coalesce(known, F.lit(False)), message).isNull())


def singleband(pixels: DataFrame, metadata: DataFrame, keys: Sequence[str], *, stretch_range=None,
               colormap: str | Mapping | None = None, colormaps: DataFrame | None = None,
               color_transform: Sequence[Transform] = (),
               at: Sequence[str] = PIXEL, percentile_base: int = 0) -> DataFrame:
    """Stretch to the dataset's range (each bound can be overridden), transform, quantise, colour.

    A mapping ``{value: colour}`` as colour map labels values instead: no
    stretch, and no colour for other values. The order of the range's bounds
    is not checked.
    """
    keys = list(keys)
    spark = pixels.sparkSession
    if isinstance(colormap, Mapping):
        labelled = pixels.select(*keys, *at, label("value", list(colormap)).alias("index"))
        return cmaps.apply_map(labelled, cmaps.explicit_map(spark, list(colormap.values())))
    joined = pixels.select(*keys, *at, "value")
    if stretch_range is None or not all(isinstance(v, (int, float)) for v in stretch_range):
        known = metadata.select(*keys, *STATS).withColumn("_known", F.lit(True))
        joined = _must_know(joined.join(known, keys, "left"), F.col("_known"), keys)
    unit = joined.withColumn("_u", contrast_stretch("value", *_range(stretch_range, percentile_base), F.lit(0.0), F.lit(1.0)))
    unit = apply_transforms(unit, color_transform, ["_u"])
    index = unit.select(*keys, *at, to_uint8("_u", F.lit(0.0), F.lit(1.0)).alias("index"))
    return _colored(index, _map_rows(spark, colormap, colormaps))


def _map_rows(spark, colormap, colormaps):
    if colormap is None:
        return None
    return cmaps.one_map(colormaps if colormaps is not None else cmaps.builtin_colormaps(spark), colormap)


def rgb(pixels: DataFrame, metadata: DataFrame, keys: Sequence[str], rgb_values: Sequence[str], *,
        stretch_ranges=None, color_transform: Sequence[Transform] = (),
        at: Sequence[str] = PIXEL, percentile_base: int = 0) -> DataFrame:
    """Three values of the last key as red, green and blue.

    Each band is stretched by its own metadata. A masked band is 0, a pixel is
    transparent only if all three are. A range whose upper bound is below the
    lower one fails the job; equal bounds are allowed.
    """
    if len(rgb_values) != 3:
        raise ValueError("an RGB composite needs three values of the last key")
    ranges = stretch_ranges if stretch_ranges is not None else (None, None, None)
    if len(ranges) != 3:
        raise ValueError("an RGB composite needs three stretch ranges")
    *other, last = keys
    names = dict(zip("rgb", rgb_values))
    bands = align_bands(pixels, keys, names, at)
    own = metadata.where(F.col(last).isin(sorted(set(rgb_values))))
    stats = F.struct(*STATS)
    per_scene = own.groupBy(*other).agg(*[
        F.max_by(stats, F.when(F.col(last) == v, F.lit(1))).alias(f"_{n}") for n, v in names.items()])
    if other:
        joined = bands.join(per_scene, other, "left")
    else:  # one key only: the metadata side is a single row
        joined = bands.withColumn("_all", F.lit(1)).join(F.broadcast(per_scene.withColumn("_all", F.lit(1))), "_all", "left")
    for n, r in zip("rgb", ranges):  # a band with values needs statistics, unless its range is given in numbers
        if r is None or not all(isinstance(v, (int, float)) for v in r):
            joined = _must_know(joined, F.col(n).isNull() | F.col(f"_{n}").isNotNull(), other)
    unit = {}
    for n, r in zip("rgb", ranges):
        lo, hi = _range(r, percentile_base, f"_{n}.")
        checked = F.when(hi < lo, F.raise_error(F.lit("upper stretch bound below lower bound")).cast("double")).otherwise(hi)
        unit[f"_u{n}"] = contrast_stretch(n, lo, checked, F.lit(0.0), F.lit(1.0))
    stretched = apply_transforms(joined.withColumns(unit), color_transform, list(unit))
    # a transform may mix bands; every band keeps its own mask
    own = {n: F.when(F.col(n).isNotNull(), F.col(f"_u{n}")) for n in "rgb"}
    out = stretched.select(*other, *at, *[to_uint8(c, F.lit(0.0), F.lit(1.0)).alias(n) for n, c in own.items()])
    return out.withColumn("a", rgb_alpha("r", "g", "b"))


def compute(pixels: DataFrame, keys: Sequence[str], operands: Mapping[str, str],
            expression: Callable[..., Column], stretch_range, *, colormap: str | None = None,
            colormaps: DataFrame | None = None, at: Sequence[str] = PIXEL) -> DataFrame:
    """A band computed from up to 5 bands of the last key, quantised over a given range.

    ``expression`` takes the operands as keyword arguments and builds a Column
    with :mod:`rastertable.functions.algebra`.
    """
    lo, hi = stretch_range
    if not hi > lo:
        raise ValueError("the upper stretch bound must be above the lower one")
    if not 1 <= len(operands) <= 5:
        raise ValueError("between 1 and 5 operands")
    *other, _ = keys
    bands = align_bands(pixels, keys, operands, at)
    result = bands.withColumn("_result", evaluate(expression(**{name: F.col(name) for name in operands})))
    index = result.select(*other, *at, to_uint8("_result", F.lit(float(lo)), F.lit(float(hi))).alias("index"))
    return _colored(index, _map_rows(pixels.sparkSession, colormap, colormaps))
