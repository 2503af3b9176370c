"""Masked-value rules as Column expressions.

A masked pixel is a NULL value. NaN and infinities never travel through the
engine: they become NULL when cells are read and again after every function
that can create them, because Spark orders NaN last, treats it as equal to
itself and lets it poison ``avg`` and ``max``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_column(x) -> Column:
    """Accept a Column, a column name or a plain number / boolean."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def finite(v) -> Column:
    """As double, with NaN and both infinities masked.

    The argument is mentioned once, so nesting does not multiply the
    expression: a remainder by infinity keeps finite values and turns
    infinities into NaN, and ``nanvl`` turns NaN into NULL.
    """
    return F.nanvl(as_column(v).cast("double") % F.lit(INF), F.lit(None).cast("double"))


def mask_nodata(v, nodata) -> Column:
    """NULL out the nodata value; a NULL nodata masks nothing."""
    v, nodata = as_column(v), as_column(nodata)
    return F.when(nodata.isNull() | (v != nodata), v)


def mask_alpha(v, alpha, has_alpha=True) -> Column:
    """NULL out pixels whose alpha is 0 or absent, where the raster has alpha at all."""
    return F.when(~as_column(has_alpha) | (as_column(alpha) != 0), as_column(v))


def read_mask(v, nodata=None, alpha=None, has_alpha=True) -> Column:
    """The mask applied on read: nodata, then alpha, then non-finite values."""
    out = as_column(v)
    if nodata is not None:
        out = mask_nodata(out, nodata)
    if alpha is not None:
        out = mask_alpha(out, alpha, has_alpha)
    return finite(out)


def any_null(*cols) -> Column:
    return reduce(lambda a, b: a | b, [as_column(c).isNull() for c in cols])


def guard(result: Column, *args) -> Column:
    """``result`` where no argument is masked, else NULL."""
    return F.when(~any_null(*args), result)
