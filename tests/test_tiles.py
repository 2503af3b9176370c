import math

import numpy as np
import pytest
from conftest import cells_frame, grids_frame
from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.operators import pyramid, stats, tiles
from rastertable.sources.cells import pack_blocks, unpack_blocks

KEYS = ["key"]


def _smooth(n=60, m=48):
    y, x = np.indices((n, m))
    return 100 + 10 * np.sin(x / 7.0) + 8 * np.cos(y / 5.0)


def _dict(df, *ids):
    return {tuple(r[i] for i in ids): r["value"] for r in df.collect()}


# the meridian arc from the equator to 45 degrees is 4984944.378 m on WGS84; the other UTM point is
# checked against Snyder's series below, which is derived another way
@pytest.mark.parametrize("crs,lon,lat,x,y", [
    ("EPSG:32631", 3.0, 45.0, 500000.0, 4984944.378 * 0.9996), ("EPSG:32731", 3.0, -45.0, 500000.0, 1e7 - 4984944.378 * 0.9996),
    ("EPSG:32631", 2.294481, 48.858370, None, None),
    ("EPSG:3857", 180.0, 0.0, 20037508.342789244, 0.0), ("EPSG:4326", 12.5, -3.25, 12.5, -3.25)])
def test_projections(spark, crs, lon, lat, x, y):
    if x is None:
        x, y = _snyder(lon, lat, 31)
    row = spark.createDataFrame([(lon, lat, crs)], "lon DOUBLE, lat DOUBLE, crs STRING")
    got = geo.project(row, geo.WGS84, crs, F.col("lon"), F.col("lat"), "e", "n").first()
    assert got["e"] == pytest.approx(x, abs=0.01) and got["n"] == pytest.approx(y, abs=0.01)
    kind = geo.UTM if crs.startswith("EPSG:32") else crs
    placed = geo.project(row, geo.WGS84, kind, F.col("lon"), F.col("lat"), "e", "n")
    back = geo.project(placed, kind, geo.WGS84, F.col("e"), F.col("n"), "lon2", "lat2").first()
    assert (back["lon2"], back["lat2"]) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))


def test_unsupported_crs(spark):
    grids = grids_frame(spark, {"a": np.ones((4, 4))}, crs="EPSG:2056")
    with pytest.raises(ValueError, match="not supported"):
        stats.geographic_bounds(grids, KEYS)


def test_tile_addresses(spark):
    row = spark.createDataFrame([(20.6852, 40.1222)], "lon DOUBLE, lat DOUBLE")
    z = F.lit(9)
    got = row.select(geo.tile_x("lon", z), geo.tile_y("lat", z)).first()
    assert tuple(got) == (285.0, 193.0)
    poles = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0)], "lon DOUBLE, lat DOUBLE")
    assert [tuple(r) for r in poles.select(geo.tile_x("lon", z), geo.tile_y("lat", z)).collect()] == [(0.0, 0.0), (511.0, 511.0)]
    deep = row.select(geo.tile_exists(F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(0), F.lit(1024))).first()
    assert deep[0] is False


def test_pack_and_unpack(spark):
    a = _smooth()
    a[5:9, 5:9] = np.nan
    cells = cells_frame(spark, {"a": a}).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    back = _dict(unpack_blocks(pack_blocks(cells, KEYS, 16), KEYS, 16).where("row < 60 AND col < 48"), "row", "col")
    assert len(back) == a.size
    assert all((v is None) == bool(np.isnan(a[rc])) and (v is None or v == a[rc]) for rc, v in back.items())


def _snyder(lon, lat, zone):
    """UTM by Snyder's series, in plain Python."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, dl = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, aa = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, dl * math.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
             + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
    east = k0 * n * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * aa**5 / 120) + 500000
    north = k0 * (m + n * math.tan(phi) * (aa**2 / 2 + (5 - t + 9 * c + 4 * c * c) * aa**4 / 24
                                          + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * aa**6 / 720))
    return east, north


def _source_position(x, y, zone, origin, pixel):
    """Fractional source column and row of a Web Mercator point."""
    lon, lat = math.degrees(x / geo.EARTH_RADIUS), math.degrees(2 * math.atan(math.exp(y / geo.EARTH_RADIUS)) - math.pi / 2)
    east, north = _snyder(lon, lat, zone)
    return (east - origin[0]) / pixel, (origin[1] - north) / pixel


@pytest.mark.parametrize("block", [16, 256])
def test_utm_tiles_against_brute_force(spark, block):
    a, origin = _smooth(), (694920.0, 2055666.0)
    a[20:23, 10:30] = np.nan
    arrays = {"u": a}
    cells = cells_frame(spark, arrays).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    grids = grids_frame(spark, arrays, pixel=10.0, origin=origin)
    layer = tiles.tile_layer(pack_blocks(cells, KEYS, block), grids, KEYS, (18,), (16, 16), block_size=block).collect()
    assert len(layer) > 1000
    size = geo.CIRCUMFERENCE / 2**18
    seen = 0
    for r in layer[::7]:
        x = r["x"] * size - geo.CIRCUMFERENCE / 2 + (r["px"] + 0.5) * size / 16
        y = geo.CIRCUMFERENCE / 2 - r["y"] * size - (r["py"] + 0.5) * size / 16
        u, v = _source_position(x, y, 37, origin, 10.0)
        assert 0 <= u <= 48 and 0 <= v <= 60
        c0, r0 = math.floor(u - 0.5), math.floor(v - 0.5)
        w = wv = 0.0
        for dr in (0, 1):
            for dc in (0, 1):
                rr, cc = r0 + dr, c0 + dc
                if 0 <= rr < 60 and 0 <= cc < 48 and not np.isnan(a[rr, cc]):
                    k = (1 - abs(u - 0.5 - cc)) * (1 - abs(v - 0.5 - rr))
                    w, wv = w + k, wv + k * a[rr, cc]
        assert r["value"] == pytest.approx(wv / w, abs=2e-3)
        seen += 1
    assert seen > 100


def test_chunks_do_not_change_tiles(spark, monkeypatch):
    arrays = {"a": _smooth(), "b": _smooth()[::-1].copy()}
    grids = grids_frame(spark, arrays, crs="EPSG:4326", pixel=0.01, origin=(10.0, 50.0))
    cells = cells_frame(spark, arrays)
    run = lambda block: _dict(tiles.tile_layer(pack_blocks(cells, KEYS, block), grids, KEYS, (8, 12), (32, 32), block_size=block,
                                               reprojection="cubic"), "key", "z", "x", "y", "py", "px")
    whole = run(256)
    monkeypatch.setattr(tiles, "CHUNK", 7)
    parts = run(8)
    assert whole.keys() == parts.keys() and len(whole) > 1000
    assert all(parts[k] == pytest.approx(v, rel=1e-9) for k, v in whole.items())


def test_out_of_bounds_and_sparse_tiles_have_no_pixels(spark):
    arrays = {"a": _smooth()}
    grids = grids_frame(spark, arrays, crs="EPSG:4326", pixel=0.01, origin=(10.0, 50.0))
    blocks = pack_blocks(cells_frame(spark, arrays), KEYS, 16)
    wanted = spark.createDataFrame([("a", 0, 10, 0), ("a", 0, 0, 0)], "key STRING, z INT, x LONG, y LONG")
    layer = tiles.tile_layer(blocks, grids, KEYS, (0,), (8, 8), tiles=wanted, block_size=16)
    assert layer.isEmpty()
    full = tiles.complete_tiles(wanted, layer, KEYS, (8, 8), fill=0.0)
    assert full.count() == 128 and full.where("value <> 0").isEmpty()
    with pytest.raises(ValueError):
        tiles.tile_layer(blocks, grids, KEYS, (8,), (8, 8), block_size=16, resampling="bogus")


def test_pyramid_levels(spark):
    sizes = {"a": np.ones((256, 256)), "b": np.ones((512, 100)), "c": np.ones((1300, 3)), "d": np.ones((100, 100))}
    got = {r["key"]: r["levels"] for r in pyramid.with_levels(grids_frame(spark, sizes)).collect()}
    want = {k: math.ceil(math.log2(max(v.shape[0] // 256, v.shape[1] // 256, 1))) for k, v in sizes.items()}
    assert got == want
    with pytest.raises(ValueError):
        pyramid.pyramid(cells_frame(spark, {"d": sizes["d"]}), grids_frame(spark, sizes), KEYS, "bogus")
    assert pyramid.pyramid(cells_frame(spark, {"d": sizes["d"]}), grids_frame(spark, {"d": sizes["d"]}), KEYS).isEmpty()


def test_written_pyramid_and_audit(spark, tmp_path):
    a = np.random.default_rng(1).random((600, 530))
    cells, grids = cells_frame(spark, {"a": a}), grids_frame(spark, {"a": a})
    path = str(tmp_path / "tiled")
    pyramid.write_pyramid(cells, grids, KEYS, path, size=64)
    stored = spark.read.parquet(path)
    assert sorted(r[0] for r in stored.select("level").distinct().collect()) == [0, 1, 2, 3, 4]
    assert pyramid.layout_audit(stored, grids, KEYS, 64).first()["valid"]
    one = _dict(unpack_blocks(pyramid.read_tiled(spark, path, 1), KEYS, 64).where("row < 300 AND col < 265"), "row", "col")
    want = a.reshape(300, 2, 265, 2).mean(axis=(1, 3))
    assert all(one[(r, c)] == pytest.approx(want[r, c]) for r in range(0, 300, 17) for c in range(0, 265, 13))
    broken = pyramid.layout_audit(stored.where("level IN (1, 2)"), grids, KEYS, 64).first()
    assert broken["errors"] == ["large raster without base blocks"] and broken["warnings"] == ["overviews missing"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        pyramid.write_pyramid(cells, grids, KEYS, path, size=64)
    level = pyramid.level_grids(grids, 1).first()
    assert (level["height"], level["width"], level["a"]) == (300, 265, 4.0)


def test_low_zoom_reads_overviews(spark):
    y, x = np.indices((256, 256))
    arrays = {"a": 100 + 10 * np.sin(x / 40.0) + 8 * np.cos(y / 30.0), "b": np.full((32, 32), 7.0)}
    cells = cells_frame(spark, arrays)
    grids = grids_frame(spark, arrays, crs="EPSG:3857", pixel=100.0, origin=(1000000.0, 6000000.0))
    base = cells.select("key", F.lit(0).alias("level"), "row", "col", "value")
    stored = pyramid.tiled_blocks(base.unionByName(pyramid.pyramid(cells, grids, KEYS, block=16)), KEYS, 16).cache()
    got = _dict(pyramid.tile_layer_from_pyramid(stored, grids, KEYS, 9, (32, 32), block_size=16), "key", "z", "x", "y", "py", "px")
    want = _dict(tiles.tile_layer(stored.where("level = 0").drop("level"), grids, KEYS, (9,), (32, 32), block_size=16),
                 "key", "z", "x", "y", "py", "px")
    assert len(got) > 50 and len(set(got) ^ set(want)) <= 0.1 * len(want)
    errors = [abs(got[k] - want[k]) for k in set(got) & set(want)]
    assert max(errors) < 4 and np.mean(errors) < 0.7


def test_pyramid_leaves_nodata_out(spark):
    a = np.full((4, 4), 2.0)
    a[0, :2] = 10000
    cells, grids = cells_frame(spark, {"a": a}), grids_frame(spark, {"a": a}, nodata=10000.0)
    got = _dict(pyramid.pyramid(cells, grids, KEYS, block=1).where("level = 1"), "row", "col")
    assert set(got.values()) == {2.0}


def test_wanted_tiles_touch_few_rows(spark):
    bounds = spark.createDataFrame([("wide", -60.0, -40.0, 60.0, 40.0), ("small", 10.0, 10.0, 10.001, 10.001), ("world", -180.0, -85.0, 180.0, 85.0)],
                                   "key STRING, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE")
    wanted = spark.createDataFrame([(21, 1 << 20, 1 << 20), (3, 4, 3), (3, 0, 0), (0, 0, 0)], "z INT, x LONG, y LONG")
    got = {tuple(r) for r in tiles.tiles_with_datasets(wanted, bounds, KEYS, (0, 3, 21)).collect()}
    cover = {tuple(r) for r in tiles.tile_cover(bounds, (0, 3)).select("z", "x", "y", "key").collect()}
    assert {t for t in got if t[0] < 21} == {t for t in cover if t[:3] in {(3, 4, 3), (3, 0, 0), (0, 0, 0)}}
    assert {t[3] for t in got if t[0] == 21} == {"wide", "world"}
