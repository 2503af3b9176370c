"""Convex hull of the valid pixels of every dataset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.functions import geo
from rastertable.functions.masks import finite
from rastertable.operators.crs import per_crs
from rastertable.sources.shared import checkpointed

CHUNK_ROWS = 1024  # raster rows whose candidates meet in one first-round group


def hull_candidates(cells: DataFrame, keys) -> DataFrame:
    """First and last valid pixel of each row and each column: row, col, once each."""
    keys = list(keys)
    valid = cells.where(finite("value").isNotNull())
    by_row = valid.groupBy(*keys, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    by_col = valid.groupBy(*keys, "col").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    ends = F.explode(F.array_distinct(F.array("lo", "hi")))
    return (by_row.select(*keys, "row", ends.alias("col"))
            .unionByName(by_col.select(*keys, ends.alias("row"), "col"))
            .distinct())


def _hull_of_points():
    """Function that reduces integer (x, y) points to hull vertices, counter-clockwise,
    collinear points left out. Made by a function so that it travels to the
    executors by value and they need not have this package installed."""
    def half(points):
        out: list = []
        for x, y in points:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0
            ):
                out.pop()
            out.append((x, y))
        return out[:-1]

    def hull(points: np.ndarray) -> np.ndarray:
        points = np.unique(points, axis=0)  # sorted by x, then y
        if len(points) < 3:
            return points
        pairs = points.tolist()
        return np.array(half(pairs) + half(pairs[::-1]))

    return hull


def hull_vertices(cells: DataFrame, keys) -> DataFrame:
    """Vertices of the hull in pixel corners: keys, ``ord``, ``x`` (column), ``y`` (row).

    Only the outermost pixels of each raster row can touch the hull, and a
    pixel is a square, so every row gives four corners. Hulls are built per
    chunk of rows first; the final group of a dataset holds chunk hulls only.
    """
    rows = (cells.where(finite("value").isNotNull())
            .groupBy(*keys, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi")))
    return vertices_of_rows(rows, keys)


def vertices_of_rows(rows: DataFrame, keys) -> DataFrame:
    """The same from the first and last valid column (``lo``, ``hi``) of each raster row."""
    keys = list(keys)
    rows = rows.select(*keys, "row", F.col("lo").alias("_lo"), (F.col("hi") + 1).alias("_hi"))
    corners = rows.select(
        *keys, F.floor(F.col("row") / CHUNK_ROWS).cast("long").alias("_chunk"),
        F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("x"), (F.col("row") + d).cast("long").alias("y"))
                            for c in ("_lo", "_hi") for d in (0, 1)])).alias("_c"),
    ).select(*keys, "_chunk", "_c.x", "_c.y")

    outer = _hull_of_points()

    def reducer(group):
        def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
            hull = outer(pdf[["x", "y"]].to_numpy(np.int64))
            out = pd.DataFrame({c: [pdf[c].iloc[0]] * len(hull) for c in group})
            return out.assign(ord=np.arange(len(hull), dtype=np.int32), x=hull[:, 0], y=hull[:, 1])
        return reduce

    def schema(df, group):
        return T.StructType([df.schema[c] for c in group] + [
            T.StructField("ord", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])

    first = [*keys, "_chunk"]
    partial = corners.groupBy(*first).applyInPandas(reducer(first), schema(corners, first))
    return partial.groupBy(*keys).applyInPandas(reducer(keys), schema(partial, keys))


def convex_hull(cells: DataFrame, grids: DataFrame, keys, crs: str | None = None) -> DataFrame:
    """Hull in degrees: ``hull`` (open ring of lon/lat) and ``convex_hull`` (GeoJSON)."""
    return _in_degrees(hull_vertices(cells, keys), grids, keys, crs)


def convex_hull_of_rows(rows: DataFrame, grids: DataFrame, keys, crs: str | None = None) -> DataFrame:
    """The same from the ends of each raster row."""
    return _in_degrees(vertices_of_rows(rows, keys), grids, keys, crs)


def _in_degrees(vertices: DataFrame, grids: DataFrame, keys, crs: str | None) -> DataFrame:
    keys, vertices = list(keys), checkpointed(vertices)  # a few points per dataset, placed once for each kind of CRS
    x, y = geo.pixel_to_xy(F.col("x").cast("double"), F.col("y").cast("double"))

    def build(some, kind):
        placed = vertices.join(some.select(*keys, *"abcdef", "crs"), keys)
        points = geo.project(placed, kind, geo.WGS84, x, y, "lon", "lat")
        return points.select(*keys, "ord", F.struct("lon", "lat").alias("_pt"))

    ring = per_crs(grids, build, crs).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ord", "_pt"))).alias("_ring"))
    return ring.select(*keys, F.col("_ring._pt").alias("hull")).withColumn("convex_hull", geojson("hull"))


def geojson(hull) -> Column:
    """A ring of lon/lat structs as a GeoJSON polygon; the first point closes it."""
    hull = F.col(hull) if isinstance(hull, str) else hull
    closed = F.concat(hull, F.slice(hull, 1, 1))
    pairs = F.transform(closed, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))
