"""Overviews in blocks and stored blocks against the forms that work on cells."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import cells_frame, grids_frame
from pyspark.sql import functions as F

from rastertable.operators import layout, overviews, pyramid, tiles
from rastertable.sources.cells import pack_blocks, unpack_blocks


def arrays():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 9, (75, 41)).astype(float)
    a[rng.random(a.shape) < 0.3] = np.nan
    a[20:60, 8:33] = 5.0
    return {"a": a, "b": np.where(rng.random((130, 130)) < 0.5, 5.0, 2.0), "c": np.full((8, 8), 1.0), "d": np.full((64, 64), np.nan)}


@pytest.mark.parametrize("method", ["average", "nearest"])
@pytest.mark.parametrize("size", [4, 8])
def test_overviews_equal_those_of_cells(spark, method, size):
    data = arrays()
    cells, grids = cells_frame(spark, data), grids_frame(spark, data, nodata=5.0)
    made = overviews.overview_blocks(pack_blocks(cells, ["key"], size), grids, ["key"], method, size)
    got = {(r.key, r.level, r.row, r.col): r.value for r in unpack_blocks(made, ["key", "level"], size).where("value IS NOT NULL").collect()}
    want = {(r.key, r.level, r.row, r.col): r.value for r in pyramid.pyramid(cells, grids, ["key"], method, size).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_one_shuffle_for_all_levels_of_a_block(spark):
    data = {"a": np.ones((300, 300))}
    blocks, grids = pack_blocks(cells_frame(spark, data), ["key"], 16).cache(), grids_frame(spark, data)
    plan = lambda size: overviews.overview_blocks(blocks, grids, ["key"], "average", size)._jdf.queryExecution().executedPlan().toString()
    exchanges = lambda text: text.count("Exchange hashpartitioning(key")
    assert 1 <= exchanges(plan(16)) <= 3  # the joins with the grids may add one each; levels add none


def test_a_batch_of_blocks_is_halved_a_few_at_a_time(spark, monkeypatch):
    """Spark's batches hold 64 MB of blocks: less than a batch is in Python's memory besides it."""
    n, size, steps = 1000, 64, []
    values = np.full((n, size * size), np.nan)
    values[:, 70], values[:, 4000] = np.arange(n), 1.0
    own = "key STRING, block_row INT, block_col INT, values ARRAY<DOUBLE>"
    blocks, grids = spark.createDataFrame([], own), spark.sql(f"SELECT 'a' AS key, {size} AS width, {n * size} AS height")
    frame = type(blocks)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, to=frame.mapInArrow, **k: steps.append(f) or to(self, f, *a, **k))
    overviews.overview_blocks(blocks, grids, ["key"], "average", size)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size * size, size * size, dtype=np.int32)), pa.array(values.ravel()))
    batch = pa.RecordBatch.from_pydict({"key": ["a"] * n, "levels": pa.array([6] * n, pa.int32()), "block_row": pa.array(range(n), pa.int32()), "block_col": pa.array([0] * n, pa.int32()),
                                        "values": lists, "_nodata": pa.nulls(n, pa.float64()), "_has_alpha": [False] * n})
    tracemalloc.start()
    rows = sum(part.num_rows for part in steps[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= n and peak < batch.nbytes


def test_sparse_blocks_in_two_rounds_of_levels(spark):
    cells = spark.range(64 * 64).select(F.lit("a").alias("key"), (F.floor(F.col("id") / 64) * 16 + 5).cast("int").alias("row"), (F.col("id") % 64 * 16 + 3).cast("int").alias("col"),
                                        (F.col("id") % 7).cast("double").alias("value"))
    grids = spark.sql("SELECT 'a' AS key, 1024 AS width, 1024 AS height")
    made = overviews.overview_blocks(pack_blocks(cells, ["key"], 16), grids, ["key"], "average", 16)
    got = {(r.level, r.row, r.col): r.value for r in unpack_blocks(made, ["key", "level"], 16).where("value IS NOT NULL").collect()}
    want = {(r.level, r.row, r.col): r.value for r in pyramid.pyramid(cells, grids, ["key"], "average", 16).collect()}
    assert got.keys() == want.keys() and max(k[0] for k in got) == 6 and all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("odd", ["alpha", "null"])
def test_overviews_mask_many_blocks_at_a_time(spark, odd):
    """Nodata and alpha of several grids within one batch, and null pixels."""
    rows = [(k, r, c, [float((r * 7 + c * 3 + i) % 5) if odd == "alpha" or (i + c) % 3 else None for i in range(16)], [(i + r) % 2 for i in range(16)]) for k in "ab" for r in range(3) for c in range(2)]
    blocks = spark.createDataFrame(rows, "key STRING, block_row INT, block_col INT, values ARRAY<DOUBLE>, alpha ARRAY<INT>").coalesce(1)
    grids = spark.createDataFrame([("a", 8, 12, 2.0, False), ("b", 8, 12, None, odd == "alpha")], "key STRING, width INT, height INT, nodata DOUBLE, has_alpha BOOLEAN")
    got = {(r.key, r.level, r.row, r.col): r.value for r in unpack_blocks(overviews.overview_blocks(blocks, grids, ["key"], "average", 4), ["key", "level"], 4).where("value IS NOT NULL").collect()}
    want = {}
    for key, r, c, values, alpha in rows:
        for i, (v, a) in enumerate(zip(values, alpha, strict=True)):
            if v is not None and (key == "b" or v != 2.0) and (key == "a" or odd == "null" or a):
                for level in (1, 2):
                    want.setdefault((key, level, r * 4 + i // 4 >> level, c * 4 + i % 4 >> level), []).append(v)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(np.mean(v)) for k, v in want.items())


def test_refuses(spark):
    data = {"a": np.ones((4, 4))}
    blocks, grids = pack_blocks(cells_frame(spark, data), ["key"], 4), grids_frame(spark, data)
    with pytest.raises(ValueError, match="power of two"):
        overviews.overview_blocks(blocks, grids, ["key"], "average", 6)
    with pytest.raises(ValueError, match="averages or nearest"):
        overviews.overview_blocks(blocks, grids, ["key"], "cubic", 4)
    with pytest.raises(ValueError, match="write mode"):
        layout.write_blocks(blocks, grids, ["key"], "/nowhere", "maybe")


def test_z_order(spark):
    rows = [(r, c) for r in range(16) for c in range(16)] + [(2**20 - 1, 2**20 - 1), (2**20 - 1, 0)]
    got = {(r.row, r.col): r.z for r in spark.createDataFrame(rows, "row int, col int").withColumn("z", layout.z_order("row", "col")).collect()}
    interleaved = lambda r, c: sum(((r >> k & 1) << 1 | c >> k & 1) << 2 * k for k in range(21))
    assert sorted(rows, key=got.get) == sorted(rows, key=lambda rc: interleaved(*rc)) and len(set(got.values())) == len(rows)


def test_stored_blocks_keep_pixels_and_masks(spark, tmp_path):
    data = arrays()
    cells, grids = cells_frame(spark, data), grids_frame(spark, data, nodata=5.0)
    path = str(tmp_path / "t")
    layout.write_blocks(pack_blocks(cells, ["key"], 16), grids, ["key"], path)
    back = {(r.key, r.row, r.col): r.value for r in unpack_blocks(layout.read_blocks(spark, path), ["key"], 16).where("value IS NOT NULL").collect()}
    want = {(k, int(r), int(c)): a[r, c] for k, a in data.items() for r, c in zip(*np.nonzero(~np.isnan(a) & (a != 5.0)), strict=True)}
    assert back == want
    raw = spark.read.parquet(path)
    assert raw.where(F.array_contains("values", 5.0)).count() > 0 and raw.where("v_max = 5").count() == 0


def test_frames_read_few_blocks(spark, tmp_path):
    """A tile over a large table: ranges are pushed, and few rows leave the scan."""
    n = 64
    blocks = spark.range(n * n).select(F.lit("big").alias("key"), F.expr(f"CAST(id div {n} AS INT)").alias("block_row"), F.expr(f"CAST(id % {n} AS INT)").alias("block_col"),
                                       F.array_repeat(F.col("id").cast("double"), 16).alias("values"))
    grids = grids_frame(spark, {"big": np.zeros((n * 4, n * 4))}, pixel=100.0, crs="epsg:3857", origin=(0.0, 0.0))
    path = str(tmp_path / "t")
    layout.write_blocks(blocks, grids, ["key"], path, files=4)
    wanted = tiles.tile_cover(spark.createDataFrame([(0.1, -0.1, 0.1, -0.1)], "west double, south double, east double, north double"), (16,)).select(F.lit("big").alias("key"), "z", "x", "y")
    frames = tiles.tile_frames(grids, ["key"], (16,), tiles=wanted)
    found = layout.read_for_frames(spark, path, frames, ["key"], tiles.TILE_IDS, block_size=4)
    assert 1 <= found.count() <= 40
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = layout.read_for_frames(spark, path, frames, ["key"], tiles.TILE_IDS, block_size=4)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(z_order" in plan and "EqualTo(key,big)" in plan
    whole = tiles.tile_layer(blocks, grids, ["key"], (16,), tiles=wanted, block_size=4)
    some = tiles.tile_layer(found, grids, ["key"], (16,), tiles=wanted, block_size=4)
    assert whole.count() > 0 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, some.collect()))
    nothing = layout.read_for_frames(spark, path, frames.limit(0), ["key"], tiles.TILE_IDS, block_size=4)
    assert nothing.count() == 0
