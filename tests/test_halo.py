"""Blocks with their neighbours' margins against padding the whole raster."""

import numpy as np
import pytest
from conftest import cells_frame
from pyspark.sql import functions as F

from rastertable.operators import tiles
from rastertable.operators.halo import masked_values, with_halo
from rastertable.sources.cells import pack_blocks

AT = ["key", "block_row", "block_col"]


@pytest.mark.parametrize("reach", [1, 2])
def test_margins(spark, reach):
    a = np.arange(12.0 * 8).reshape(12, 8)
    a[4:8, 0:4] = np.nan  # one block is absent
    a[0, 7] = -1.0
    blocks = pack_blocks(cells_frame(spark, {"a": a}).where("NOT isnan(value)"), ["key"], 4).withColumns(
        {"width": F.lit(7), "height": F.lit(12), "nodata": F.lit(-1.0), "has_alpha": F.lit(False)})
    padded = with_halo(blocks.select(*AT, masked_values(F.col("values"), 4).alias("values")), AT, reach, 4)
    got = {(r.block_row, r.block_col): np.array(r["pad"]).reshape(4 + 2 * reach, -1) for r in padded.collect()}
    whole = np.pad(np.where(a == -1, np.nan, a), 4 + reach, constant_values=np.nan)
    whole[:, 4 + reach + 7:] = np.nan  # beyond the raster
    assert {(r, c) for r in range(3) for c in range(2)} <= got.keys()
    for (r, c), pad in got.items():
        top, left = (r + 1) * 4, (c + 1) * 4
        if 0 <= r < 3 and 0 <= c < 2:
            np.testing.assert_array_equal(pad, whole[top:top + 4 + 2 * reach, left:left + 4 + 2 * reach])
    with pytest.raises(ValueError):
        with_halo(blocks, AT, 5, 4)


def test_linear_has_no_aggregate(spark):
    grids = spark.createDataFrame([("a", 8, 8, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, "EPSG:3857", None, "float64", False)],
                                  "key string, width int, height int, a double, b double, c double, d double, e double, f double, crs string, nodata double, dtype string, has_alpha boolean")
    blocks = spark.createDataFrame([("a", 0, 0, [1.0] * 64)], "key string, block_row int, block_col int, values array<double>")
    frames = tiles.reprojected_frames(grids, ["key"], "EPSG:3857")
    made = tiles.warp(blocks, frames, ["key"], (), "linear", 8, "EPSG:3857")
    assert {r.v for r in made.collect()} == {1.0} and made.count() == 64
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "vr#" in plan and not any("Aggregate" in line and "vr#" in line for line in plan.splitlines())
