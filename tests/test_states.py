"""Statistics of stored blocks against NumPy and against the statistics of cells."""

import numpy as np
import pytest
from conftest import cells_frame, circle_raster, float_raster, grids_frame, small_raster
from pyspark.sql import functions as F

from rastertable.operators import states as S
from rastertable.operators.stats import compute_metadata
from rastertable.sources.cells import pack_blocks


def rasters():
    rng = np.random.default_rng(4)
    many = rng.standard_normal((300, 200)) * 1e6
    many[:, 50] = 10000
    skewed = np.exp(rng.standard_normal((130, 260)) * 5)
    skewed[rng.random(skewed.shape) < 0.4] = 7.0
    return {"circle": circle_raster(), "small": small_raster().astype(float), "float": float_raster(), "many": many, "skewed": skewed,
            "one": np.full((3, 5), 2.5), "empty": np.full((40, 40), 10000.0), "two": np.array([[1.0, np.inf], [np.nan, 3.0]])}


@pytest.fixture(scope="module")
def stored(spark):
    arrays = rasters()
    cells, grids = cells_frame(spark, arrays), grids_frame(spark, arrays, nodata=10000.0)
    blocks = pack_blocks(cells, ["key"], 64).cache()
    return arrays, cells, grids, blocks


def valid(a):
    v = np.asarray(a, float).ravel()
    return v[np.isfinite(v) & (v != 10000)]


@pytest.mark.parametrize("digest", [2000, 40])
def test_exact(stored, digest, monkeypatch):
    """With a small digest brackets are wide and some are missed; results stay exact."""
    monkeypatch.setattr(S, "FAN", 2)
    arrays, _, grids, blocks = stored
    states = S.checkpointed(S.states_of_blocks(blocks, grids, ["key"], 64, digest))
    merged = S.checkpointed(S.merged_states(states, ["key"], digest))
    found = {r.key: r for r in S.moments_of(merged, ["key"]).collect()}
    ranks = {r.key: r.percentiles for r in S.exact_percentiles_of_blocks(blocks, grids, ["key"], merged, node=50).collect()}
    assert set(found) == set(ranks) == {k for k, a in arrays.items() if len(valid(a))}
    for key, r in found.items():
        v = valid(arrays[key])
        assert (r.n_valid, r.min, r.max) == (len(v), v.min(), v.max())
        assert r.mean == pytest.approx(v.mean(), rel=1e-9) and r.stdev == pytest.approx(v.std(), rel=1e-9, abs=1e-12)
        assert ranks[key] == pytest.approx(np.percentile(v, range(1, 100)).tolist(), rel=1e-9)


def test_missed_brackets(stored, monkeypatch):
    """Brackets that hold nothing of what is wanted: the counts at their ends lead to ones that do."""
    arrays, _, grids, blocks = stored
    true = S._brackets
    monkeypatch.setattr(S, "_brackets", lambda m, k: true(m, k).withColumns({"lo": F.col("hi") + 0.25, "hi": F.col("hi") + 0.5}))
    merged = S.checkpointed(S.merged_states(S.states_of_blocks(blocks, grids, ["key"], 64, 30), ["key"], 30))
    for r in S.exact_percentiles_of_blocks(blocks, grids, ["key"], merged).collect():
        assert r.percentiles == pytest.approx(np.percentile(valid(arrays[r.key]), range(1, 100)).tolist(), rel=1e-9)


def test_digest_error(stored, monkeypatch):
    """Ranks read from digests are within four centroids of the true ones, in whatever order states were merged."""
    arrays, _, grids, blocks = stored
    states = S.checkpointed(S.states_of_blocks(blocks, grids, ["key"], 64, 100))
    for fan in (2, 16):
        monkeypatch.setattr(S, "FAN", fan)
        for r in S.digest_percentiles(S.merged_states(states.repartition(fan), ["key"], 100), ["key"]).collect():
            v = np.sort(valid(arrays[r.key]))
            for p, q in enumerate(r.percentiles, 1):
                low, high = np.searchsorted(v, q - abs(q) * 1e-9, "left"), np.searchsorted(v, q + abs(q) * 1e-9, "right")
                at = (len(v) - 1) * p / 100
                assert low - 0.04 * len(v) - 1 <= at <= high + 0.04 * len(v) + 1


def test_metadata_equals_that_of_cells(stored):
    arrays, cells, grids, blocks = stored
    extra = grids.select("key", F.lit('{"a": 1}').alias("metadata")).where("key = 'one'")
    got = {r.key: r for r in S.metadata_of_blocks(blocks, grids, ["key"], size=64, extra=extra).collect()}
    want = {r.key: r for r in compute_metadata(cells, grids, ["key"], extra=extra).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert {c: v for c, v in got[k].asDict().items() if c not in ("percentiles", "mean", "stdev")} == {
            c: v for c, v in w.asDict().items() if c not in ("percentiles", "mean", "stdev")}
        assert got[k].percentiles == pytest.approx(w.percentiles, rel=1e-6) and got[k].stdev == pytest.approx(w.stdev, rel=1e-9, abs=1e-12)


def test_alpha(spark):
    a = np.arange(36.0).reshape(6, 6)
    blocks = pack_blocks(cells_frame(spark, {"k": a, "l": a}), ["key"], 4)
    blocks = blocks.withColumn("alpha", F.transform("values", lambda v, i: F.when(i % 2 == 1, 255).otherwise(0)))
    grids = grids_frame(spark, {"k": a, "l": a}).withColumn("has_alpha", F.col("key") == "k")
    got = {r.key: (r.n_valid, r.min) for r in S.moments_of(S.merged_states(S.states_of_blocks(blocks, grids, ["key"], 4), ["key"]), ["key"]).collect()}
    assert got == {"k": (18, 1.0), "l": (36, 0.0)}
