"""Colour map tables: name, idx 0..254, r, g, b, a (0..255).

A colour map colours the quantised values 1..255; value 0 is transparent.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions.color import to_uint8

MAP_SIZE = 255
SUFFIX = "_rgba.npy"
SCHEMA = "name STRING, idx INT, r INT, g INT, b INT, a INT"

# fixed values: (position, red), (position, green), (position, blue) corners of
# the classic piecewise linear maps
CONTROL_POINTS = {
    "autumn": (((0, 1), (1, 1)), ((0, 0), (1, 1)), ((0, 0), (1, 0))),
    "bone": (((0, 0), (0.746032, 0.652778), (1, 1)),
             ((0, 0), (0.365079, 0.319444), (0.746032, 0.777778), (1, 1)),
             ((0, 0), (0.365079, 0.444444), (1, 1))),
    "cool": (((0, 0), (1, 1)), ((0, 1), (1, 0)), ((0, 1), (1, 1))),
    "copper": (((0, 0), (0.809524, 1), (1, 1)), ((0, 0), (1, 0.7812)), ((0, 0), (1, 0.4975))),
    "gray": (((0, 0), (1, 1)), ((0, 0), (1, 1)), ((0, 0), (1, 1))),
    "hot": (((0, 0.0416), (0.365079, 1), (1, 1)),
            ((0, 0), (0.365079, 0), (0.746032, 1), (1, 1)),
            ((0, 0), (0.746032, 0), (1, 1))),
    "jet": (((0, 0), (0.35, 0), (0.66, 1), (0.89, 1), (1, 0.5)),
            ((0, 0), (0.125, 0), (0.375, 1), (0.64, 1), (0.91, 0), (1, 0)),
            ((0, 0.5), (0.11, 1), (0.34, 1), (0.65, 0), (1, 0))),
    "spring": (((0, 1), (1, 1)), ((0, 0), (1, 1)), ((0, 1), (1, 0))),
    "summer": (((0, 0), (1, 1)), ((0, 0.5), (1, 1)), ((0, 0.4), (1, 0.4))),
    "winter": (((0, 0), (1, 0)), ((0, 0), (1, 1)), ((0, 1), (1, 0.5))),
}


LOOKUP_SIZE = 256  # fixed value: the classic maps are tables of 256 colours, read at 255 positions


def _piecewise(i: Column, corners, reverse: bool) -> Column:
    """Height of a corner line at table position i (0..255)."""
    end = LOOKUP_SIZE - 1
    if reverse:
        corners = tuple((1 - x, y) for x, y in reversed(corners))
    out = F.lit(float(corners[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(corners, corners[1:]))):
        share = (i - F.lit(x0 * end)) / F.lit((x1 - x0) * end)
        out = F.when(i <= x1 * end, share * F.lit(float(y1 - y0)) + F.lit(float(y0))).otherwise(out)
    return out


def builtin_colormaps(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """The shipped maps (a reversed twin ``<name>_r`` for each), 255 rows per map."""
    base = spark.range(MAP_SIZE).select(F.col("id").cast("int").alias("idx"))
    entry = F.least(F.floor(F.col("idx") / F.lit(MAP_SIZE - 1.0) * F.lit(float(LOOKUP_SIZE))), F.lit(LOOKUP_SIZE - 1))
    out = None
    for full in available():
        if names is not None and full not in names:
            continue
        reverse = full.endswith("_r")
        level = lambda corners: F.floor(_piecewise(entry.cast("double"), corners, reverse) * F.lit(255.0)).cast("int")
        bands = CONTROL_POINTS[full.removesuffix("_r")]
        rows = base.select(F.lit(full).alias("name"), "idx", *[level(c).alias(n) for n, c in zip("rgb", bands)],
                           F.lit(255).alias("a"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"unknown colormap, choose from {available()}")
    return out


def available() -> list[str]:
    return sorted([*CONTROL_POINTS, *(f"{n}_r" for n in CONTROL_POINTS)])


def read_colormap_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Maps kept as ``<name>_rgba.npy`` arrays of 255 x 4 uint8; other shapes and types fail the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)

    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1][: -len(SUFFIX)].lower()
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.shape != (MAP_SIZE, 4) or array.dtype != np.uint8:
                    raise ValueError(f"colormap {name}: needs 255 x 4 uint8, is {array.shape} {array.dtype}")
                yield pd.DataFrame(array.astype("int32"), columns=list("rgba")).assign(
                    name=name, idx=np.arange(MAP_SIZE, dtype="int32"))[["name", "idx", "r", "g", "b", "a"]]

    return files.select("path", "content").mapInPandas(decode, SCHEMA)


def override(colormaps: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom maps replace shipped ones of the same name."""
    custom = custom.withColumn("name", F.lower("name"))
    return colormaps.join(custom.select("name").distinct(), "name", "left_anti").unionByName(custom)


def colormap_audit(colormaps: DataFrame) -> DataFrame:
    """Per map: is it whole (255 positions, once each, all values in 0..255)?"""
    in_range = F.lit(True)
    for c in "rgba":
        in_range = in_range & F.col(c).between(0, 255)
    return colormaps.groupBy("name").agg(
        F.count("*").alias("n_rows"),
        ((F.count("*") == MAP_SIZE) & (F.count_distinct("idx") == MAP_SIZE) & (F.min("idx") == 0)
         & (F.max("idx") == MAP_SIZE - 1) & F.min(F.coalesce(in_range, F.lit(False)))).alias("valid"))


def one_map(colormaps: DataFrame, name: str) -> DataFrame:
    """The 255 rows of a map, by name in any case; small enough to broadcast by definition."""
    found = colormaps.where(F.col("name") == name.lower()).select("idx", "r", "g", "b", "a")
    if found.isEmpty():
        raise ValueError(f"unknown colormap {name!r}")
    return found


def explicit_map(spark: SparkSession, colors: Sequence) -> DataFrame:
    """A map for values 1..n out of at most 255 colours: (r, g, b), (r, g, b, a) or hex text."""
    if len(colors) > MAP_SIZE:
        raise ValueError("an explicit colour map holds at most 255 colours")
    rows = []
    for i, color in enumerate(colors):
        if isinstance(color, str):
            h = color.lstrip("#")
            if len(h) != 6:
                raise ValueError(f"not a hex colour: {color!r}")
            color = tuple(int(h[k:k + 2], 16) for k in (0, 2, 4))
        rgba = tuple(int(v) for v in color) + ((255,) if len(color) == 3 else ())
        if len(rgba) != 4 or not all(0 <= v <= 255 for v in rgba):
            raise ValueError(f"not an RGB or RGBA colour: {color!r}")
        rows.append((i, *rgba))
    return spark.createDataFrame(rows, "idx INT, r INT, g INT, b INT, a INT")


def apply_map(pixels: DataFrame, rows: DataFrame, index: str = "index") -> DataFrame:
    """Add r, g, b, a. Value 0 and values past the end of the map are transparent black."""
    joined = pixels.join(F.broadcast(rows.withColumn("_index", F.col("idx") + 1).drop("idx")),
                         F.col(index) == F.col("_index"), "left").drop("_index")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in "rgba"})


def color_bars(ranges: DataFrame, keys, rows: DataFrame | None = None, num_values: int = MAP_SIZE) -> DataFrame:
    """A colour bar per row of ``ranges`` (keys, min, max): keys, ord, value, r, g, b, a.

    Values are evenly spaced over the range; without a map the colours are grey.
    """
    lo, hi, i = F.col("min").cast("double"), F.col("max").cast("double"), F.col("ord")
    spaced = i * ((hi - lo) / F.lit(float(max(num_values - 1, 1)))) + lo
    value = F.when((i == num_values - 1) & F.lit(num_values > 1), hi).otherwise(spaced)
    bar = (ranges.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(num_values - 1))))
           .withColumn("value", value).withColumn("index", to_uint8("value", "min", "max")))
    if rows is None:
        bar = bar.withColumns({"r": F.col("index"), "g": F.col("index"), "b": F.col("index"), "a": F.lit(255)})
    else:
        bar = apply_map(bar, rows)
    return bar.select(*keys, "ord", "value", "r", "g", "b", "a")


def color_bar(spark: SparkSession, stretch_range, rows: DataFrame | None = None, num_values: int = MAP_SIZE) -> DataFrame:
    """The colour bar of one given range."""
    lo, hi = (float(v) for v in stretch_range)
    one = spark.range(1).select(F.lit(lo).alias("min"), F.lit(hi).alias("max"))
    return color_bars(one, [], rows, num_values)
