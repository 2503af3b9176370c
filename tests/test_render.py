import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertable.functions import color as C
from rastertable.operators import colormaps as M
from rastertable.operators import render
from rastertable.operators import transforms as T


def _map(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_stretch(spark):
    v = [float(i) for i in range(10)]
    lit = lambda *a: [F.lit(float(x)) for x in a]
    assert _map(spark, v, lambda c: C.contrast_stretch(c, *lit(0, 10, 10, 20))) == [i + 10 for i in v]
    assert _map(spark, v, lambda c: C.contrast_stretch(c, *lit(5, 6, 10, 20))) == [10.0] * 6 + [20.0] * 4
    assert _map(spark, v, lambda c: C.contrast_stretch(c, *lit(5, 6, 10, 20), clip=False)) == [-40.0 + 10 * i for i in range(10)]


def test_uint8(spark):
    v = [-50.0, 0.0, 10.0, 255.0, 256.0, 1000.0, None, float("nan"), float("inf"), float("-inf")]
    assert _map(spark, v, lambda c: C.to_uint8(c, F.lit(-50.0), F.lit(1000.0))) == [1, 13, 16, 75, 75, 255, 0, 0, 255, 1]


@pytest.mark.parametrize("labels", [[17, 15], [17, 15, *range(100, 120)]])
def test_label(spark, labels):
    assert _map(spark, [15.0, 16.0, 17.0, None], lambda c: C.label(c, labels)) == [2, 0, 1, 0]
    with pytest.raises(ValueError):
        C.label(F.lit(1), list(range(256)))


def test_stretch_bound(spark):
    p = F.array(*[F.lit(float(i)) for i in range(1, 100)])
    get = lambda b, **k: spark.range(1).select(C.stretch_bound(b, p, F.lit(-1.0), **k)).first()[0]
    assert (get("p2"), get("p2", percentile_base=1), get("p0"), get(7), get(None)) == (3.0, 2.0, 1.0, 7.0, -1.0)
    for bad in ("s2", "pp2", "p", "2", "p-2", "p298", "p99"):
        with pytest.raises(ValueError):
            C.stretch_bound(bad, p, F.lit(0.0))


def test_color_transforms(spark):
    df = spark.createDataFrame([(0.0, 0.4, 1.0), (0.2, 0.2, 0.2), (0.9, 0.5, 0.1)], "r DOUBLE, g DOUBLE, b DOUBLE")
    run = lambda *ops: np.array([tuple(r) for r in T.apply_transforms(df, ops, ["r", "g", "b"]).collect()])
    base = run()
    np.testing.assert_array_equal(run(T.gamma("rgb", 1), T.sigmoidal("rgb", 0, 0.5), T.saturation(1)), base)
    np.testing.assert_allclose(run(T.gamma("2", 2))[:, 1], np.sqrt(base[:, 1]))
    np.testing.assert_allclose(run(T.sigmoidal("rgb", 5, 0.3), T.sigmoidal("rgb", -5, 0.3)), base, atol=1e-9)
    grey = run(T.saturation(0))
    np.testing.assert_allclose(grey.max(axis=1), grey.min(axis=1), atol=1e-4)
    np.testing.assert_allclose(run(T.saturation(0.9999999)), base, atol=1e-5)
    for bad in (lambda: T.gamma("r", -1.5), lambda: T.sigmoidal("r", 5, 2)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        T.apply_transforms(df, [T.gamma("g", 1.5)], ["r"])


def test_colormaps(spark, tmp_path):
    maps = M.builtin_colormaps(spark)
    audit = M.colormap_audit(maps).collect()
    assert {r["name"] for r in audit} == set(M.available()) and all(r["valid"] for r in audit)
    grey = [tuple(r) for r in M.one_map(maps, "Gray").orderBy("idx").collect()]
    assert grey[0] == (0, 0, 0, 0, 255) and grey[-1] == (254, 255, 255, 255, 255)
    with pytest.raises(ValueError):
        M.one_map(maps, "nope")
    custom = np.arange(255 * 4, dtype="uint64").astype("uint8").reshape(255, 4)
    np.save(tmp_path / "jet_rgba.npy", custom)
    own = M.override(maps, M.read_colormap_folder(spark, str(tmp_path)))
    assert [list(tuple(r)[1:]) for r in M.one_map(own, "jet").orderBy("idx").collect()] == custom.tolist()
    np.save(tmp_path / "bad_rgba.npy", custom[:10])
    with pytest.raises(Exception, match="255 x 4"):
        M.read_colormap_folder(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        M.explicit_map(spark, ["#12345"])


@pytest.mark.parametrize("stretch", [(0.0, 0.1), (20000.0, 30000.0), (-50000.0, 50000.0)])
def test_color_bar_is_the_map(spark, stretch):
    rows = M.one_map(M.builtin_colormaps(spark), "jet")
    bar = [tuple(r)[2:] for r in M.color_bar(spark, stretch, rows).orderBy("ord").collect()]
    assert bar == [tuple(r)[1:] for r in rows.orderBy("idx").collect()]


@pytest.fixture(scope="module")
def bands(spark):
    rows = [("s", b, 0, i, None if (b, i) in {("r", 0), ("g", 0), ("b", 0), ("r", 3)} else float(i * k)) for k, b in enumerate("rgb", 1) for i in range(20)]
    cells = spark.createDataFrame(rows, "scene STRING, band STRING, row INT, col INT, value DOUBLE")
    meta = cells.groupBy("scene", "band").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                              F.percentile("value", F.array(*[F.lit(p / 100) for p in range(1, 100)])).alias("percentiles"))
    return cells, meta


def test_rgb(bands):
    cells, meta = bands
    out = {r["col"]: r for r in render.rgb(cells, meta, ["scene", "band"], ["r", "g", "b"], stretch_ranges=[None, (0, 10), (5, 5)]).collect()}
    assert tuple(out[0])[3:] == (0, 0, 0, 0)
    assert (out[3]["r"], out[3]["a"]) == (0, 255) and out[3]["g"] == 153
    assert (out[1]["r"], out[19]["r"], out[19]["g"]) == (1, 255, 255)
    assert out[1]["b"] == 1 and out[2]["b"] == 255  # flat range: shifted only, then cut
    with pytest.raises(Exception, match="upper stretch bound"):
        render.rgb(cells, meta, ["scene", "band"], ["r", "g", "b"], stretch_ranges=[(5, 1), None, None]).collect()
    with pytest.raises(ValueError):
        render.rgb(cells, meta, ["scene", "band"], ["r", "g"])


def test_compute_checks(bands):
    cells, _ = bands
    with pytest.raises(ValueError):
        render.compute(cells, ["scene", "band"], {"v1": "r"}, lambda v1: v1, (1, 1))


def test_singleband_colormap_and_transform(bands):
    cells, meta = bands
    one = cells.where("band = 'r'")
    plain = render.singleband(one, meta, ["scene", "band"]).collect()
    same = render.singleband(one, meta, ["scene", "band"], color_transform=[T.gamma("1", 1)]).collect()
    assert sorted(plain) == sorted(same)
    labelled = {r["col"]: r for r in render.singleband(one, meta, ["scene", "band"], colormap={4: (9, 8, 7), 5: "#010203"}).collect()}
    assert tuple(labelled[4])[4:] == (1, 9, 8, 7, 255) and tuple(labelled[5])[4:] == (2, 1, 2, 3, 255)
    assert tuple(labelled[6])[4:] == (0, 0, 0, 0, 0)
