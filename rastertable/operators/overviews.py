"""Overviews built inside stored blocks.

A block of side 2^k holds all pixels of its own share of levels 1 to k, so those are halved in place, one after the other, without moving
a pixel. The shares of one overview block then meet in one shuffle for all k levels: 4^l shares of level l, together never more than a
block. Level k is again a table of such blocks, which gives the next k levels. A share carries its valid pixels alone, each with its place
in the overview block, so a sparse raster moves what it holds; blocks are laid out in full only a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.operators.pyramid import with_levels
from rastertable.operators.percentiles import _size_checked
from rastertable.operators.states import _valid, with_masks
from rastertable.sources.cells import BATCH_PIXELS, BLOCK_SIZE, whole_groups
from rastertable.sources.shared import checkpointed, new_folder

_PIXELS = {"places": "<u4", "found": "<f8", "weighed": "<f8"}  # of the valid pixels of a share: where they go, their values and weights
_SLICE_PIXELS = BATCH_PIXELS // 4  # pixels of the blocks that are halved, or put together, at a time


def _halved(values: np.ndarray, weights: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of 2 x 2 pixels (or their first pixel) and their weights, of many blocks."""
    if method == "nearest":
        return values[:, ::2, ::2], weights[:, ::2, ::2]
    quarters = lambda a: a[:, ::2, ::2] + a[:, ::2, 1::2] + a[:, 1::2, ::2] + a[:, 1::2, 1::2]
    total = quarters(weights)
    return quarters(values * weights) / np.maximum(total, 1), total


def overview_blocks(blocks: DataFrame, grids: DataFrame, keys, method: str = "average", size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks of all overviews of base blocks: keys, level (1..), block_row, block_col, values (masked pixels NaN).

    Equal to packing the cells of ``pyramid``. Nodata, alpha and non-finite pixels count as masked; overview blocks without any valid pixel are left out.
    """
    keys = list(keys)
    if method not in ("average", "nearest"):
        raise ValueError(f"overviews in blocks are averages or nearest, not {method!r}")
    depth = size.bit_length() - 1
    if size != 1 << depth or depth < 1:
        raise ValueError("the side of a block must be a power of two")
    grids = checkpointed(with_levels(grids.select([c for c in (*keys, "width", "height", "nodata", "has_alpha") if c in grids.columns]), size))
    own = [c for c in (*keys, "block_row", "block_col", "values", "alpha") if c in blocks.columns]
    now = with_masks(blocks.select(own), grids, keys).join(_size_checked(grids.select(*keys, "levels")), keys).where("levels > 0")
    top = grids.agg(F.max("levels")).first()[0] or 0  # one number, at most about 20
    out = None
    for base in range(0, max(top, 1), depth):
        shares = _shares(now.where(F.col("levels") > base), keys, base, depth, size, method)
        merge, schema = _merged([*keys, "level", "block_row", "block_col"]), shares.schema
        if base + depth < top:  # kept as valid pixels: read again as the base of the levels above
            folder = new_folder(blocks.sparkSession, "overviews")
            shares.mapInArrow(merge, schema).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(folder)
            kept = blocks.sparkSession.read.schema(schema).parquet(folder)
            part = kept.mapInArrow(_laid_out(keys, size), _blocks_schema(schema, keys))
            now = kept.where(F.col("level") == base + depth).select(*keys, "levels", "block_row", "block_col", *_PIXELS)
        else:
            lay_out = _laid_out(keys, size)
            part = shares.mapInArrow(lambda batches, merge=merge, lay_out=lay_out: lay_out(merge(batches)), _blocks_schema(schema, keys))
        out = part if out is None else out.unionByName(part)
    return out


def _base_pixels(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where masked) and weights of base blocks under the rules of their grids."""
    lists, none, alpha = (batch.column(batch.schema.get_field_index(c)) for c in ("values", "_nodata", "_has_alpha"))
    if lists.null_count or any(alpha.to_pylist()):
        pixels = list(_valid(batch))
        values, good = (np.array([p[k] for p in pixels]).reshape(-1, size, size) for k in range(2))
    else:
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
        good = np.isfinite(values)
        if none.null_count < len(none):
            good &= values != none.to_numpy(zero_copy_only=False)[:, None, None]  # null is NaN here, which no value equals
    return np.where(good, values, 0.0), good.astype(float)


def _level_pixels(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of overview blocks."""
    at = batch.schema.get_field_index
    (places, count), (found, _), (weighed, _) = (_numbers(batch.column(at(c)), kind) for c, kind in _PIXELS.items())
    values, weights = np.zeros((2, batch.num_rows, size * size))
    block = np.repeat(np.arange(batch.num_rows), count)
    values[block, places], weights[block, places] = found, weighed
    return values.reshape(-1, size, size), weights.reshape(-1, size, size)


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a binary column holds, end to end, and how many each row has."""
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _shares(blocks: DataFrame, keys, base: int, depth: int, size: int, method: str) -> DataFrame:
    """Shares of the blocks of levels base+1 to base+depth that blocks of level ``base`` hold, sorted by the block that they make."""
    group = [*keys, "level", "block_row", "block_col"]
    pixels_of = _level_pixels if base else _base_pixels
    at_once = max(1, _SLICE_PIXELS // (size * size))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                at = batch.schema.get_field_index
                levels, row, col = (batch.column(at(c)).to_numpy() for c in ("levels", "block_row", "block_col"))
                v, w = pixels_of(batch, size)
                which, out = np.arange(len(levels)), []
                for k in range(1, depth + 1):
                    deep = levels[which] >= base + k
                    if not deep.all():
                        which, v, w = which[deep], v[deep], w[deep]
                    v, w = _halved(v, w, method)
                    some = w.any((1, 2))
                    if not some.all():
                        which, v, w = which[some], v[some], w[some]
                    if not len(which):
                        break
                    share, r, c = np.nonzero(w)
                    side, inner = size >> k, (1 << k) - 1
                    places = ((row[which] & inner) * side)[share] + r
                    places = places * size + ((col[which] & inner) * side)[share] + c
                    numbers = (np.full(len(which), base + k), row[which] >> k, col[which] >> k)
                    out.append((which, numbers, np.bincount(share, minlength=len(which)), (places, v[share, r, c], w[share, r, c])))
                if out:
                    taken = pa.array(np.concatenate([o[0] for o in out]))
                    columns = [batch.column(at(c)).take(taken) for c in (*keys, "levels")]
                    columns += [pa.array(np.concatenate([o[1][k] for o in out]).astype(np.int32)) for k in range(3)]
                    ends = np.concatenate([[0], np.cumsum(np.concatenate([o[2] for o in out]))])
                    for k, kind in enumerate(_PIXELS.values()):
                        data = np.concatenate([o[3][k] for o in out]).astype(kind)
                        columns.append(pa.Array.from_buffers(pa.binary(), len(taken), [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "levels", *group[len(keys):], *_PIXELS])

    integers = [F.col(c).cast("int").alias(c) for c in ("levels", "block_row", "block_col")]
    blocks = blocks.select(*keys, *integers, *(c for c in blocks.columns if c not in (*keys, "levels", "block_row", "block_col")))
    schema = T.StructType([blocks.schema[c] for c in (*keys, "levels")] + [T.StructField(c, T.IntegerType()) for c in group[len(keys):]]
                          + [T.StructField(c, T.BinaryType()) for c in _PIXELS])
    return blocks.mapInArrow(halve, schema).repartition(*group).sortWithinPartitions(*group)


def _merged(group: list[str]):
    """Shares of one block, which lie side by side, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, group):
            columns, first = [], pa.array(starts)
            for name, column in zip(rows.schema.names, rows.columns, strict=True):
                if name not in _PIXELS:
                    columns.append(column.take(first))
                    continue
                data, count = _numbers(column, "u1")
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat(count, starts))]).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return run


def _blocks_schema(shares: T.StructType, keys) -> T.StructType:
    return T.StructType([*(shares[c] for c in (*keys, "level", "block_row", "block_col")), T.StructField("values", T.ArrayType(T.DoubleType()))])


def _laid_out(keys, size: int):
    """Blocks in full out of their valid pixels."""
    head, at_once = [*keys, "level", "block_row", "block_col"], max(1, _SLICE_PIXELS // (size * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                (places, count), (found, _) = (_numbers(column(c), _PIXELS[c]) for c in ("places", "found"))
                pixels = np.full((batch.num_rows, size * size), np.nan)
                pixels[np.repeat(np.arange(batch.num_rows), count), places] = found
                offsets = np.arange(0, (batch.num_rows + 1) * size * size, size * size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*map(column, head), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pixels.ravel()))], names=[*head, "values"])

    return run
