import numpy as np
import pytest
from conftest import cells_frame, circle_raster, float_raster, grids_frame, masked, small_raster
from pyspark.sql import functions as F

from rastertable.operators import hull, percentiles, stats

KEYS = ["key"]
RASTERS = {"nodata": small_raster(), "nan": float_raster(), "circle": circle_raster()}


@pytest.fixture(scope="module")
def rasters(spark):
    cells = cells_frame(spark, RASTERS).cache()
    grids = grids_frame(spark, RASTERS, nodata=10000.0)
    return cells, grids, stats.masked_cells(cells, grids, KEYS).cache()


def _check(row, key, rtol=1e-9):
    valid = masked(RASTERS[key]).compressed()
    total = RASTERS[key].size
    assert row["valid_percentage"] == pytest.approx(100 * valid.size / total)
    assert (row["min"], row["max"]) == (valid.min(), valid.max())
    assert row["mean"] == pytest.approx(valid.mean(), rel=1e-9)
    assert row["stdev"] == pytest.approx(valid.std(), rel=1e-9)
    np.testing.assert_allclose(row["percentiles"], np.percentile(valid, np.arange(1, 100)), rtol=rtol, atol=valid.max() / 100 if rtol > 1e-3 else 1e-9)


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_stats(rasters, method):
    _, grids, valid = rasters
    rows = stats.dataset_stats(valid, grids, KEYS, method).collect()
    assert len(rows) == 3
    for row in rows:
        _check(row, row["key"], 2e-2 if method == "approx" else 1e-9)


@pytest.mark.parametrize("node_pixels,buckets", [(60, 64), (1000, 1 << 14)])
def test_exact_percentiles_by_refinement(rasters, node_pixels, buckets):
    """Small nodes force several passes; one dataset is all ties, one has far outliers."""
    *_, valid = rasters
    spark = valid.sparkSession
    rng = np.random.default_rng(3)
    outliers = np.concatenate([rng.random(3000), [1e300, -1e300, 1e-300]])
    more = spark.createDataFrame(
        [("ties", 0, i, 5.0) for i in range(400)] + [("one", 0, 0, 3.5)]
        + [("outliers", 0, i, float(v)) for i, v in enumerate(outliers)], "key STRING, row INT, col INT, value DOUBLE")
    data = valid.where("key = 'circle' AND row < 60").select("key", "row", "col", "value").unionByName(more)
    got = {r["key"]: r["percentiles"] for r in percentiles.exact_percentiles(
        data, KEYS, node_pixels=node_pixels, buckets=buckets).collect()}
    want = data.where("value IS NOT NULL").toPandas().groupby("key")["value"].apply(np.array)
    assert set(got) == set(want.index)
    for key, values in want.items():
        np.testing.assert_allclose(got[key], np.percentile(values, np.arange(1, 100)), rtol=1e-12, err_msg=key)


def test_exact_at_every_size(rasters):
    _, grids, valid = rasters
    wide = grids.withColumn("width", F.lit(20_000)).withColumn("height", F.lit(20_000))
    for row in stats.dataset_stats(valid, wide, KEYS).collect():
        assert row["percentile_method"] == "exact"
        np.testing.assert_allclose(row["percentiles"], np.percentile(masked(RASTERS[row["key"]]).compressed(), np.arange(1, 100)), rtol=1e-9)


def test_alpha_only_where_there_is_alpha(rasters):
    spark = rasters[1].sparkSession
    cells = spark.createDataFrame([("a", 0, 0, 1.0, None), ("b", 0, 0, 2.0, 1), ("b", 0, 1, 3.0, 0), ("b", 0, 2, float("nan"), 1), ("b", 0, 3, float("-inf"), 1)],
                                  "key STRING, row INT, col INT, value DOUBLE, alpha INT")
    grids = spark.createDataFrame([("a", None, False), ("b", None, True)], "key STRING, nodata DOUBLE, has_alpha BOOLEAN")
    got = {(r["key"], r["col"]): r["value"] for r in stats.masked_cells(cells, grids, KEYS).collect()}
    assert got == {("a", 0): 1.0, ("b", 0): 2.0, ("b", 1): None, ("b", 2): None, ("b", 3): None}


def test_decimated(rasters):
    _, grids, valid = rasters
    thin, thin_grids = stats.decimate(valid, grids, KEYS, (100, 77))
    got = {(r["key"], r["row"], r["col"]): r["value"] for r in thin.collect()}
    for key, a in RASTERS.items():
        ri = ((2 * np.arange(100) + 1) * 256) // 200
        ci = ((2 * np.arange(77) + 1) * 256) // 154
        want = masked(a)[np.ix_(ri, ci)].filled(np.nan)
        have = np.array([[got[(key, i, j)] if got[(key, i, j)] is not None else np.nan for j in range(77)] for i in range(100)])
        np.testing.assert_array_equal(have, want)
    g = thin_grids.first()
    assert (g["height"], g["width"]) == (100, 77) and g["a"] * 77 == pytest.approx(512)


def test_block_states_merge(rasters):
    *_, valid = rasters
    states = stats.block_states(valid, KEYS, 37)
    for row in stats.merge_states(states, KEYS).collect():
        values = masked(RASTERS[row["key"]]).compressed()
        assert row["n_valid"] == values.size and row["stdev"] == pytest.approx(values.std())


def test_empty_is_rejected(spark):
    arrays = {"full": np.ones((4, 4)), "empty": np.zeros((4, 4))}
    grids = grids_frame(spark, arrays, nodata=0.0)
    valid = stats.masked_cells(cells_frame(spark, arrays), grids, KEYS)
    accepted, rejected = stats.split_empty(stats.dataset_stats(valid, grids, KEYS))
    assert [r["key"] for r in accepted.collect()] == ["full"] and [r["key"] for r in rejected.collect()] == ["empty"]


def test_options_exclude_each_other(rasters):
    cells, grids, _ = rasters
    with pytest.raises(ValueError):
        stats.compute_metadata(cells, grids, KEYS, use_chunks=True, max_shape=(10, 10))
    with pytest.raises(ValueError):
        stats.compute_metadata(cells, grids, KEYS, max_shape=(10,))


def _brute_hull(mask):
    """Gift wrapping over all pixel corners."""
    r, c = np.nonzero(mask)
    pts = np.unique(np.concatenate([np.stack([c + i, r + j], 1) for i in (0, 1) for j in (0, 1)]), axis=0)
    start = tuple(pts[0])
    out, p = [], start
    while True:
        out.append(p)
        d = pts - p
        best = None
        for q, v in zip(map(tuple, pts), d):
            if q == p:
                continue
            if best is None:
                best, bv = q, v
                continue
            cross = bv[0] * v[1] - bv[1] * v[0]
            if cross < 0 or (cross == 0 and (v ** 2).sum() > (bv ** 2).sum()):
                best, bv = q, v
        p = best
        if p == start:
            return set(out)


def test_hull_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hull, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(5)
    arrays = {"dots": np.where(rng.random((30, 40)) < 0.02, 1.0, np.nan), "full": np.ones((9, 5)),
              "one": np.where(np.indices((5, 5)).sum(0) == 3, 1.0, np.nan)}
    arrays["dots"][3, 3] = 1.0
    cells = cells_frame(spark, arrays)
    rows = hull.hull_vertices(cells, KEYS).collect()
    for key, a in arrays.items():
        assert {(r["x"], r["y"]) for r in rows if r["key"] == key} == _brute_hull(~np.isnan(a)), key
    n = {key: 0 for key in arrays}
    for r in hull.hull_candidates(cells, KEYS).collect():
        assert not np.isnan(arrays[r["key"]][r["row"], r["col"]])
        n[r["key"]] += 1
    assert n["full"] == 9 * 5 - 7 * 3


def test_metadata_of_utm_rasters(rasters):
    cells, grids, _ = rasters
    rows = {r["key"]: r for r in stats.compute_metadata(cells, grids, KEYS).collect()}
    assert set(rows) == set(RASTERS)
    r = rows["nodata"]
    # the corner (694920, 2055666) of zone 37 north lies near 40.84 E, 18.58 N
    assert 40.8 < r["west"] < r["east"] < 40.9 and 18.5 < r["south"] < r["north"] < 18.6
    assert r["convex_hull"].startswith('{"type":"Polygon","coordinates":[[[')
    assert len(r["percentiles"]) == 99 and r["metadata"] == "{}"


def test_hull_in_degrees_covers_bounds(spark):
    arrays = {"full": np.ones((64, 64))}
    grids = grids_frame(spark, arrays, crs="EPSG:4326", pixel=0.5, origin=(10.0, 40.0))
    ring = hull.convex_hull(cells_frame(spark, arrays), grids, KEYS).first()["hull"]
    assert {(p["lon"], p["lat"]) for p in ring} == {(10.0, 40.0), (42.0, 40.0), (10.0, 8.0), (42.0, 8.0)}


def test_fill_missing(rasters):
    cells, grids, _ = rasters
    datasets = grids.select("key", F.lit("p").alias("path"))
    known = stats.compute_metadata(cells, grids, KEYS).where("key = 'nan'")
    filled = stats.fill_missing(datasets, known, cells, grids, KEYS)
    assert {r["key"] for r in filled.collect()} == set(RASTERS)
