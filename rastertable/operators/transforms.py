"""Chains of colour transforms on bands stretched to [0, 1].

A transform takes a table and its band columns and returns the table with
those columns changed. Working on columns of a table keeps each step a
projection of its own, so formulas that use a value many times do not blow up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.functions import color as C

Transform = Callable[[DataFrame, Sequence[str]], DataFrame]
BAND_NAMES = {"r": 0, "g": 1, "b": 2, "1": 0, "2": 1, "3": 2}


def _chosen(bands: str, columns: Sequence[str]) -> list[str]:
    if not bands or set(bands) - set(BAND_NAMES):
        raise ValueError(f"bands are r, g, b or 1, 2, 3, not {bands!r}")
    positions = sorted({BAND_NAMES[b] for b in bands})
    if positions[-1] >= len(columns):
        raise ValueError(f"no band {bands!r} in {len(columns)} band data")
    return [columns[i] for i in positions]


def gamma(bands: str, g: float) -> Transform:
    """Gamma correction of some bands."""
    C.gamma(F.lit(1.0), g)  # checks g

    def apply(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return df.withColumns({c: C.gamma(c, g) for c in _chosen(bands, columns)})
    return apply


def sigmoidal(bands: str, contrast: float, bias: float) -> Transform:
    """Sigmoidal contrast of some bands."""
    C.sigmoidal(F.lit(1.0), contrast, bias)  # checks the bias

    def apply(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return df.withColumns({c: C.sigmoidal(c, contrast, bias) for c in _chosen(bands, columns)})
    return apply


def saturation(proportion: float) -> Transform:
    """Scale the chroma of RGB in CIE LCH, keeping lightness and hue.

    Scaling chroma scales the a* and b* axes, so the hue is never computed.
    Results are cut to [0, 1].
    """
    p = F.lit(float(proportion))

    def dot(row, names):
        return sum((F.lit(m) * F.col(n) for m, n in zip(row[1:], names[1:])), F.lit(row[0]) * F.col(names[0]))

    def apply(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        if len(columns) != 3:
            raise ValueError("saturation needs three bands")
        if proportion == 1:
            return df
        lin, xyz, axes = (["_l0", "_l1", "_l2"], ["_x0", "_x1", "_x2"], ["_f0", "_f1", "_f2"])
        out = df.withColumns({n: C.srgb_to_linear(c) for n, c in zip(lin, columns)})
        out = out.withColumns({n: dot(row, lin) / F.lit(w) for n, row, w in zip(xyz, C.RGB_TO_XYZ, C.WHITE)})
        out = out.withColumns({n: C.cie_f(x) for n, x in zip(axes, xyz)})
        # f_x - f_y carries a*, f_y - f_z carries b*
        out = out.withColumns({n: F.col("_f1") + (F.col(n) - F.col("_f1")) * p for n in ("_f0", "_f2")})
        out = out.withColumns({n: C.cie_f_inverse(f) * F.lit(w) for n, f, w in zip(xyz, axes, C.WHITE)})
        out = out.withColumns({n: dot(row, xyz) for n, row in zip(lin, C.XYZ_TO_RGB)})
        out = out.withColumns({c: C.linear_to_srgb(n) for c, n in zip(columns, lin)})
        return out.withColumns({c: C.clip_unit(c) for c in columns}).drop(*lin, *xyz, *axes)
    return apply


def apply_transforms(df: DataFrame, transforms: Sequence[Transform], columns: Sequence[str]) -> DataFrame:
    for transform in transforms:
        df = transform(df, columns)
    return df
