"""Blocks with a margin of their neighbours' pixels, so that a kernel around any pixel of a block reads one array.

Blocks exchange strips, not pixels: each sends its edge rows, edge columns and corners to the up to eight blocks around it. A strip is a
slice of the block's array; what is shuffled beyond the blocks themselves is their rims, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.functions.masks import read_mask

SIDES = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def masked_values(values: Column, size: int, alpha: Column | None = None) -> Column:
    """A block's pixels with NaN for masked ones and those beyond the raster's ``width`` and ``height``.

    Columns ``block_row``, ``block_col``, ``width``, ``height``, ``nodata`` and ``has_alpha`` are those of the row. An array with nothing to mask stays as it is.
    """
    rows, cols = F.col("height") - F.col("block_row") * size, F.col("width") - F.col("block_col") * size
    beyond = lambda i: (i % size >= cols) | (i >= rows * size)
    nan, has_alpha = F.lit(float("nan")), F.coalesce("has_alpha", F.lit(False))
    inside = lambda v, i: F.when(~beyond(i), F.coalesce(read_mask(v, F.col("nodata")), nan)).otherwise(nan)
    plain = (F.col("nodata").isNull() & (rows >= size) & (cols >= size)
             & ~F.coalesce(F.array_contains(values, float("inf")) | F.array_contains(values, float("-inf")), F.lit(True)))
    out = F.when(plain, values).otherwise(F.transform(values, inside))
    if alpha is None:
        return out
    seen = F.zip_with(values, alpha, lambda v, a: F.when(a != 0, v))
    return F.when(has_alpha, F.transform(seen, inside)).otherwise(out)


def _strip(values: Column, dr: int, dc: int, reach: int, size: int) -> Column:
    """The part of a block's array that belongs into the margin of the block that has it at (dr, dc)."""
    span = {-1: (size - reach, reach), 0: (0, size), 1: (0, reach)}
    (row, n_rows), (col, n_cols) = span[dr], span[dc]
    if n_cols == size:
        return F.slice(values, row * size + 1, n_rows * size)
    return F.flatten(F.transform(F.sequence(F.lit(row), F.lit(row + n_rows - 1)), lambda r: F.slice(values, r * size + (col + 1), n_cols)))


def with_halo(blocks: DataFrame, at: list[str], reach: int, size: int) -> DataFrame:
    """``at`` (the block's address) and ``pad``: (size + 2 reach) squared pixels, those around the block being its neighbours'.

    ``blocks`` has ``at`` and ``values``, size x size pixels with NaN for masked ones. Places without a neighbour are NaN. A block that is absent
    comes too, wholly NaN inside, where a neighbour of it is there.
    """
    if reach > size:
        raise ValueError(f"a margin of {reach} pixels needs blocks of at least as many, not {size}")
    sent = blocks.select(*at, "values").withColumn("_sent", F.explode(F.array(*[
        F.struct(F.lit(k).alias("side"), (F.col("block_row") - dr).alias("row"), (F.col("block_col") - dc).alias("col"),
                 _strip(F.col("values"), dr, dc, reach, size).alias("strip")) for k, (dr, dc) in enumerate(SIDES)])))
    keys = [c for c in at if c not in ("block_row", "block_col")]
    got = sent.select(*keys, F.col("_sent.row").alias("block_row"), F.col("_sent.col").alias("block_col"), "_sent.side", "_sent.strip").groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("side", "strip"))).alias("_strips"))
    joined = blocks.select(*at, "values").join(got, at, "full")
    blank = lambda n: F.array_repeat(F.lit(float("nan")), n)
    parts = {(0, 0): F.coalesce("values", blank(size * size))}
    for k, (dr, dc) in enumerate(SIDES):
        n = (size if dr == 0 else reach) * (size if dc == 0 else reach)
        parts[dr, dc] = F.coalesce(F.element_at("_strips", F.lit(k)), blank(n))
    laid = geo.once(joined.select(*at, "values", "_strips"), **{f"_p{dr + 1}{dc + 1}": c for (dr, dc), c in parts.items()})

    def band(dr: int) -> Column:
        """Rows of the wider block above, beside or below it."""
        cut = lambda r, dc: F.slice(f"_p{dr + 1}{dc + 1}", r * (size if dc == 0 else reach) + 1, size if dc == 0 else reach)
        return F.transform(F.sequence(F.lit(0), F.lit((size if dr == 0 else reach) - 1)), lambda r: F.concat(*[cut(r, dc) for dc in (-1, 0, 1)]))

    return laid.select(*at, F.flatten(F.concat(*[band(dr) for dr in (-1, 0, 1)])).alias("pad"))
