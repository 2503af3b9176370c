"""Jobs over datasets of several reference systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from rastertable.functions import geo


def per_crs(grids: DataFrame, build, crs: str | None = None) -> DataFrame:
    """``build(grids, crs)`` for the grids of each kind of CRS, put together.

    The formulas of a kind are compiled only when a grid needs them. Looks at
    the grid table for the kinds in use (five at most) unless ``crs`` tells.
    """
    if crs is not None:
        return build(grids, crs)
    kind = geo.crs_kind("crs")
    kinds = [r[0] for r in grids.select(kind.alias("kind")).distinct().collect()]
    if None in kinds:
        raise ValueError(f"some grids have a CRS that is not supported: use EPSG:4326, EPSG:3857, WGS84 UTM or one of {sorted([*geo.CONICS, *geo.EQUAL_AREAS])}")
    parts = [build(grids.where(kind == k), k) for k in sorted(kinds)] or [build(grids, geo.WEB_MERCATOR)]
    return reduce(lambda a, b: a.unionByName(b), parts)
