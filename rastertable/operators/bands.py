"""Bands of one scene side by side: one row per pixel, one column per band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXEL = ("row", "col")


def align_bands(cells: DataFrame, keys: Sequence[str], bands: Mapping[str, str],
                at: Sequence[str] = PIXEL, value: str = "value") -> DataFrame:
    """Pivot the last key. ``bands`` maps output columns to values of the last key.

    Every pixel with at least one of the bands gets a row; a missing band is
    NULL. A pivot over named bands is a plain aggregate: unwanted bands are
    filtered at the scan and pixels combine before the shuffle.
    """
    *other, last = keys
    wanted = cells.where(F.col(last).isin(sorted(set(bands.values()))))
    return wanted.groupBy(*other, *at).agg(
        *[F.max(F.when(F.col(last) == F.lit(band), F.col(value))).alias(name) for name, band in bands.items()])
