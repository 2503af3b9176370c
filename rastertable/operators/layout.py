"""Stored blocks: clustered along a Z curve, each with a bit mask of its valid pixels, read by frames through pushed ranges.

A table holds one folder per level. Inside a level, blocks are sorted by dataset and by their place on the Z curve, so blocks that are
near each other on the raster lie in few row groups, and ranges of the curve are pushed into the Parquet scan. The mask keeps stored
pixels as they are; readers get masked pixels as NaN, whatever consumes them, and blocks without a valid pixel are skipped by their count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.operators.crs import per_crs
from rastertable.operators.states import _valid, with_masks
from rastertable.operators.tiles import _chunk_blocks, _chunks
from rastertable.sources.cells import BLOCK_SIZE

#: Ranges of blocks that a scan is given at most; more are widened to whole datasets, then to a range of them.
PUSHED_RANGES = 200
_SUMMARY = [T.StructField("n_valid", T.IntegerType()), T.StructField("v_min", T.DoubleType()), T.StructField("v_max", T.DoubleType()),
            T.StructField("valid", T.BinaryType())]


def z_order(row, col) -> Column:
    """Place of a block on the Z curve: the bits of row and column in turn (21 bits of each)."""
    def spread(c):
        c = (F.col(c) if isinstance(c, str) else c).cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    # every third bit is left free, which keeps the order
    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def with_validity(blocks: DataFrame, grids: DataFrame, keys) -> DataFrame:
    """Blocks with ``valid`` (a bit per pixel, row by row), ``n_valid``, ``v_min`` and ``v_max`` under the nodata and alpha rules of their grids."""
    own = with_masks(blocks, grids, list(keys))
    head = [c for c in own.columns if c not in ("_nodata", "_has_alpha", "alpha")]
    schema = T.StructType([own.schema[c] for c in head] + _SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(good.sum()), *((v[good].min(), v[good].max()) if good.any() else (None, None)), np.packbits(good).tobytes()) for v, good in _valid(batch)]
            more = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4,
                                                               (pa.int32(), pa.float64(), pa.float64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in head), *more], names=[*head, *(f.name for f in _SUMMARY)])

    return own.mapInArrow(run, schema)


def masked_values(blocks: DataFrame) -> DataFrame:
    """Blocks of a stored table with their masked pixels NaN, without the summary columns."""
    head = [c for c in blocks.columns if c not in (*(f.name for f in _SUMMARY), "values")]
    schema = T.StructType([blocks.schema[c] for c in head] + [T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            lists, masks = batch.column(at("values")), batch.column(at("valid")).to_pylist()
            size = np.asarray(lists.value_lengths(), np.int64)
            bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(masks, size, strict=True)]
            flat = np.asarray(lists.flatten(), np.float64)
            if bits:
                flat = np.where(np.concatenate(bits), flat, np.nan)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in head), values], names=[*head, "values"])

    return blocks.mapInArrow(run, schema)


def write_blocks(blocks: DataFrame, grids: DataFrame, keys, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Write base blocks (or blocks of several levels) under the rules of their grids. ``alpha`` goes into the mask."""
    if mode not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown write mode {mode!r}")
    if "level" not in blocks.columns:
        blocks = blocks.withColumn("level", F.lit(0))
    order = ["level", *keys, "z_order"]
    placed = with_validity(blocks, grids, keys).withColumn("z_order", z_order("block_row", "block_col"))
    ranged = placed.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    # small row groups: a range of the curve reads a few of them
    ranged.write.partitionBy("level").option("parquet.block.size", 8 << 20).parquet(path, mode=mode, compression="zstd")


def read_blocks(spark: SparkSession, path: str, level: int = 0, where: Column | None = None) -> DataFrame:
    """Blocks of one level with at least one valid pixel: keys, block_row, block_col, values (masked pixels NaN).
    ``where`` may name keys, block_row, block_col, z_order, n_valid, v_min and v_max, and is pushed into the scan."""
    found = spark.read.parquet(path).where((F.col("level") == level) & (F.col("n_valid") > 0))
    return masked_values(found if where is None else found.where(where)).drop("level", "z_order")


def blocks_under(frames: DataFrame, keys, ids, reach: int = 2, block_size: int = BLOCK_SIZE) -> DataFrame:
    """keys, block_row, block_col of the source blocks that frames read."""
    def build(some, kind):
        return _chunk_blocks(_chunks(some, keys, ids), kind, reach, block_size).select(*keys, "block_row", "block_col")

    return per_crs(frames, build).distinct()


def wanted_ranges(frames: DataFrame, keys, ids, reach: int = 2, block_size: int = BLOCK_SIZE) -> Column | None:
    """A condition on a stored table that holds for all blocks that ``frames`` read: per dataset, a range of the Z curve and of rows and columns.

    It comes to the driver: at most PUSHED_RANGES rows; beyond that only the smallest and largest first key. None where there is no frame.
    """
    keys = list(keys)
    ranges = blocks_under(frames, keys, ids, reach, block_size).groupBy(*keys).agg(
        F.min(z_order("block_row", "block_col")).alias("z0"), F.max(z_order("block_row", "block_col")).alias("z1"),
        *(f(c).alias(f"{c}_{n}") for c in ("block_row", "block_col") for f, n in ((F.min, 0), (F.max, 1))))
    found = ranges.limit(PUSHED_RANGES + 1).collect()
    if not found:
        return None
    if len(found) > PUSHED_RANGES:
        low, high = frames.agg(F.min(keys[0]), F.max(keys[0])).first()
        return F.col(keys[0]).between(low, high)
    return reduce(Column.__or__, [
        reduce(Column.__and__, [F.col(k) == r[k] for k in keys] + [F.col("z_order").between(r["z0"], r["z1"])]
               + [F.col(c).between(r[f"{c}_0"], r[f"{c}_1"]) for c in ("block_row", "block_col")]) for r in found])


def read_for_frames(spark: SparkSession, path: str, frames: DataFrame, keys, ids, level: int = 0, reach: int = 2, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The stored blocks that frames may read, found by pushed ranges instead of a scan of the table."""
    ranges = wanted_ranges(frames, keys, ids, reach, block_size)
    return read_blocks(spark, path, level, F.lit(False) if ranges is None else ranges)
