"""Stretching, quantising and colouring of pixel values as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastertable.functions.masks import as_column, finite

# fixed values
FLAT_RANGE = 1e-8     # input spans up to this are shifted, not scaled
MAX_LABELS = 255      # 0 is kept for transparent pixels
NUM_PERCENTILES = 99  # percentiles 1..99 are stored


def contrast_stretch(v, lo, hi, out_lo, out_hi, clip: bool = True) -> Column:
    """Map [lo, hi] to [out_lo, out_hi]; a flat input range is only shifted.

    NaN stays NaN under clipping (a bare ``least``/``greatest`` would hide it).
    """
    v, lo, hi, out_lo, out_hi = (as_column(c).cast("double") for c in (v, lo, hi, out_lo, out_hi))
    span = hi - lo
    scale = F.when(F.abs(span) > FLAT_RANGE, F.try_divide(out_hi - out_lo, span)).otherwise(F.lit(1.0))
    out = (v - lo) * scale + out_lo
    if clip:
        out = F.when(v.isNull() | F.isnan(v), v).otherwise(F.least(F.greatest(out, out_lo), out_hi))
    return out


def to_uint8(v, lo, hi) -> Column:
    """Quantise to 1..255, half to even; masked and NaN pixels are 0, infinities are clipped."""
    scaled = F.rint(contrast_stretch(v, lo, hi, F.lit(1.0), F.lit(255.0)))
    return F.coalesce(finite(scaled).cast("int"), F.lit(0))


def label(v, labels: list) -> Column:
    """1-based position of the value in ``labels``; 0 when absent or masked.

    When a label is repeated the last position wins.
    """
    if len(labels) > MAX_LABELS:
        raise ValueError("at most 255 labels fit beside the transparent index")
    v = as_column(v).cast("double")
    if not labels:
        return F.lit(0)
    positions = {float(x): i for i, x in enumerate(labels, 1)}
    out = F.lit(None).cast("int")
    if len(positions) <= 8:
        for value, i in positions.items():
            out = F.when(v == F.lit(value), F.lit(i)).otherwise(out)
        return F.coalesce(out, F.lit(0))
    lookup = F.create_map(*[F.lit(x) for pair in positions.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, v), F.lit(0))


def stretch_bound(bound, percentiles, default, percentile_base: int = 0) -> Column:
    """One bound of a stretch range.

    ``None`` takes the dataset's own bound, a number is used as it is, and
    ``pNN`` picks entry NN of the 99 stored percentiles. The list is indexed
    from 0, so ``p2`` is the 3rd percentile; ``percentile_base=1`` gives the
    documented meaning, where ``p2`` is the 2nd.
    """
    if bound is None:
        return as_column(default)
    if isinstance(bound, bool) or not isinstance(bound, (int, float, str)):
        raise ValueError(f"a stretch bound is a number or text like p2, not {bound!r}")
    if isinstance(bound, (int, float)):
        return F.lit(float(bound))
    if not re.fullmatch(r"p[+-]?\d+", bound):
        raise ValueError(f"a stretch bound is a number or text like p2, not {bound!r}")
    index = int(bound[1:]) - percentile_base
    if not 0 <= index < NUM_PERCENTILES:
        raise ValueError(f"no such percentile: {bound!r}")
    return F.get(as_column(percentiles), F.lit(index)).cast("double")


# --- colour transforms on data stretched to [0, 1] -------------------------

def gamma(v, g: float) -> Column:
    if g <= 0:
        raise ValueError("gamma must be greater than 0")
    return F.pow(as_column(v), F.lit(1.0 / g))


def sigmoidal(v, contrast: float, bias: float) -> Column:
    """Sigmoidal contrast; positive contrast steepens around ``bias``, negative undoes it."""
    v = as_column(v)
    if not 0 <= bias <= 1:
        raise ValueError("bias must be between 0 and 1")
    if contrast == 0:
        return v
    # a bias of exactly 0 or 1 is moved just off the edge
    alpha = min(max(bias, 1e-12), 1 - 1e-12)
    beta = float(contrast)
    a, b = F.lit(alpha), F.lit(beta)

    def logistic(t):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(b * (a - t)))

    low, high = logistic(F.lit(0.0)), logistic(F.lit(1.0))
    if beta > 0:
        return (logistic(v) - low) / (high - low)
    # inverse of the forward curve for the opposite contrast
    b = F.lit(-beta)
    low, high = logistic(F.lit(0.0)), logistic(F.lit(1.0))
    y = v * (high - low) + low
    return a - F.ln(F.lit(1.0) / y - F.lit(1.0)) / b


# fixed values: sRGB primaries and D65 white point, CIE lightness constants
WHITE = (0.95047, 1.0, 1.08883)
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375),
              (0.2126729, 0.7151522, 0.0721750),
              (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314),
              (-0.9692660, 1.8760108, 0.0415560),
              (0.0556434, -0.2040259, 1.0572252))
CIE_EPSILON, CIE_KAPPA = 216 / 24389, 24389 / 27


def srgb_to_linear(c) -> Column:
    c = as_column(c)
    return F.when(c <= 0.04045, c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def linear_to_srgb(c) -> Column:
    c = as_column(c)
    return F.when(c <= 0.0031308, c * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(c, F.lit(1 / 2.4)) - F.lit(0.055))


def cie_f(t) -> Column:
    t = as_column(t)
    return F.when(t > CIE_EPSILON, F.cbrt(t)).otherwise((F.lit(CIE_KAPPA) * t + F.lit(16.0)) / F.lit(116.0))


def cie_f_inverse(t) -> Column:
    t = as_column(t)
    return F.when(t * t * t > CIE_EPSILON, t * t * t).otherwise((F.lit(116.0) * t - F.lit(16.0)) / F.lit(CIE_KAPPA))


def clip_unit(c) -> Column:
    """Cut to [0, 1]; masked stays masked."""
    c = as_column(c)
    return F.when(c < 0, F.lit(0.0)).when(c > 1, F.lit(1.0)).otherwise(c)


# --- colours ---------------------------------------------------------------

def hex_to_rgba(text) -> Column:
    """``#rrggbb`` (the # may be missing) to an opaque RGBA struct."""
    h = F.ltrim(as_column(text), F.lit("#"))
    part = [F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    return F.struct(part[0].alias("r"), part[1].alias("g"), part[2].alias("b"), F.lit(255).alias("a"))


def grey(v) -> Column:
    """Colour of a quantised pixel without a colour map: its grey level, 0 transparent."""
    v = as_column(v)
    return F.struct(v.alias("r"), v.alias("g"), v.alias("b"),
                    F.when(v == 0, F.lit(0)).otherwise(F.lit(255)).alias("a"))


def rgb_alpha(r, g, b) -> Column:
    """An RGB pixel is transparent only when all three bands are 0."""
    r, g, b = (as_column(c) for c in (r, g, b))
    return F.when((r == 0) & (g == 0) & (b == 0), F.lit(0)).otherwise(F.lit(255))
