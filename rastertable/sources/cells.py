"""Cells (one row per pixel) and blocks (one row per square of pixels).

Cells are the working form. Blocks are the storage and lookup form: a block
row carries its pixels as one array in row-major order, so a join moves one
row per block instead of one per pixel. A block holds at most size x size
pixels, so building one never gathers an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.functions.masks import finite

BATCH_PIXELS = 1 << 20  # pixels of the blocks that are laid out at a time
BLOCK_SIZE = 256  # fixed value: side of a storage block in pixels


def block_of(c, size: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size)).cast("int")


def whole_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by ``group`` in pieces of whole groups, with the first row of each; the last, perhaps unfinished group of a batch waits for the next."""
    held = None
    for batch in chain(batches, [None]):
        if batch is None:
            rows = held
        elif batch.num_rows == 0:
            continue
        else:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if rows is None:
            return
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in group:
            column = rows.column(rows.schema.get_field_index(name))
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            other = pc.fill_null(pc.not_equal(here, before), False)
            new[1:] |= pc.or_(other, pc.xor(here.is_null(), before.is_null())).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        if batch is None:
            yield rows, starts
        else:
            held = rows.slice(int(starts[-1]))
            if len(starts) > 1:
                yield rows.slice(0, int(starts[-1])), starts[:-1]


def pack_blocks(cells: DataFrame, keys, size: int = BLOCK_SIZE, value: str = "value") -> DataFrame:
    """Cells to blocks. Absent and masked cells are NaN in the array.

    Spark shuffles and sorts the pixels by block; the Arrow function only lays out
    blocks of at most size x size pixels, many small ones at a time.
    """
    keys = list(keys)
    tagged = cells.where(F.col(value).isNotNull()).select(
        *keys,
        block_of("row", size).alias("block_row"),
        block_of("col", size).alias("block_col"),
        (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("_p"),
        F.col(value).cast("double").alias("_v"),
    )
    group = [*keys, "block_row", "block_col"]
    schema = T.StructType([tagged.schema[c] for c in group] + [T.StructField("values", T.ArrayType(T.DoubleType()))])
    at_once = max(1, BATCH_PIXELS // (size * size))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, group):
            column = lambda c: rows.column(rows.schema.get_field_index(c))
            places, found = column("_p").to_numpy(zero_copy_only=False), column("_v").to_numpy(zero_copy_only=False)
            ends = np.append(starts[1:], rows.num_rows)
            for i in range(0, len(starts), at_once):
                first, n = starts[i:i + at_once], ends[i:i + at_once] - starts[i:i + at_once]
                pixels, own = np.full((len(n), size * size), np.nan), slice(int(first[0]), int(first[0] + n.sum()))
                pixels[np.repeat(np.arange(len(n)), n), places[own]] = found[own]
                offsets = np.arange(0, (len(n) + 1) * size * size, size * size, dtype=np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pixels.ravel()))
                yield pa.RecordBatch.from_arrays([*(column(c).take(pa.array(first)) for c in group), values], names=[*group, "values"])

    return tagged.repartition(*group).sortWithinPartitions(*group).mapInArrow(lay_out, schema)


def unpack_blocks(blocks: DataFrame, keys, size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks back to cells; masked pixels stay as NULL rows."""
    return blocks.select(*keys, "block_row", "block_col", F.posexplode("values").alias("_p", "value")).select(
        *keys,
        (F.col("block_row") * size + F.floor(F.col("_p") / size)).cast("int").alias("row"),
        (F.col("block_col") * size + F.col("_p") % size).cast("int").alias("col"),
        finite("value").alias("value"),
    )
