"""Projections against published points, round trips, and a tile layer against its own inverse."""

import numpy as np
import pytest
from conftest import cells_frame, grids_frame
from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.operators import stats, tiles
from rastertable.sources.cells import pack_blocks

POINTS = [  # published coordinates
    ("EPSG:3035", 5.0, 50.0, 3962799.45, 2999718.85),
    ("EPSG:3035", 10.0, 52.0, 4321000.0, 3210000.0),
    ("EPSG:2154", 3.0, 46.5, 700000.0, 6600000.0),
    ("EPSG:2154", 2.3522, 48.8566, 652469.02, 6862035.26),
    ("EPSG:3413", -45.0, 90.0, 0.0, 0.0),
    ("EPSG:3031", 0.0, -90.0, 0.0, 0.0),
]


def kind_of(code):
    return geo.CONIC if code in geo.CONICS else geo.EQUAL_AREA


@pytest.mark.parametrize("kind", [geo.CONIC, geo.EQUAL_AREA])
def test_published_points(spark, kind):
    rows = [p for p in POINTS if kind_of(p[0]) == kind]
    df = spark.createDataFrame(rows, "crs string, lon double, lat double, x double, y double")
    for r in geo.project(df, geo.WGS84, kind, F.col("lon"), F.col("lat"), "px", "py").collect():
        assert (r.px, r.py) == pytest.approx((r.x, r.y), abs=0.5)


def test_polar_constants():
    """The published example of variant B: 75 S, 120 E, standard parallel 71 S, longitude of origin 70 E."""
    k = geo.conic(70.0, 6_000_000.0, 6_000_000.0, (-71.0,))
    rho = k["c"] * np.exp(-k["n"] * geo._isometric(-75.0))
    theta = k["n"] * np.radians(50.0)
    assert (k["x0"] + rho * np.sin(theta), k["y0"] + k["rho0"] - rho * np.cos(theta)) == pytest.approx((7255380.79, 7053389.56), abs=0.05)


@pytest.mark.parametrize("code", [*geo.CONICS, *geo.EQUAL_AREAS])
def test_round_trip(spark, code):
    rng = np.random.default_rng(1)
    centre = {"EPSG:3031": (0, -75), "EPSG:3413": (-45, 75), "EPSG:3995": (0, 80)}.get(code, (8, 50))
    pts = [(code, float(centre[0] + dx), float(centre[1] + dy)) for dx, dy in rng.uniform(-10, 10, (200, 2))]
    df = spark.createDataFrame(pts, "crs string, lon double, lat double")
    out = geo.project(df, geo.WGS84, kind_of(code), F.col("lon"), F.col("lat"), "x", "y")
    back = geo.project(out, kind_of(code), geo.WGS84, F.col("x"), F.col("y"), "lon2", "lat2").collect()
    assert all((r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-8) for r in back)


@pytest.mark.parametrize("code,origin", [("epsg:3035", (4321000.0, 3210000.0)), ("epsg:2154", (700000.0, 6600000.0)), ("epsg:3413", (1e6, -1e6))])
def test_tiles(spark, code, origin):
    """Stored pixels are their own source column: a tile shows where each of its pixels lies, within an eighth of a pixel."""
    size = 200
    raster = np.tile(np.arange(size, dtype=float), (size, 1))
    blocks = pack_blocks(cells_frame(spark, {"k": raster}), ["key"], 64)
    grids = grids_frame(spark, {"k": raster}, pixel=100.0, crs=code, origin=origin)
    box = stats.geographic_bounds(grids, ["key"]).first()
    assert box.west < box.east and box.south < box.north
    pixels = tiles.tile_layer(blocks, grids, ["key"], (13,), (32, 32), block_size=64).withColumns(geo.tile_bounds("z", "x", "y"))
    mx = F.col("left") + (F.col("px") + 0.5) * (F.col("right") - F.col("left")) / 32
    my = F.col("top") - (F.col("py") + 0.5) * (F.col("top") - F.col("bottom")) / 32
    at = geo.project(pixels.withColumns({"crs": F.lit(code)}), geo.WEB_MERCATOR, kind_of(code.upper()), mx, my, "sx", "sy").withColumn(
        "u", (F.col("sx") - origin[0]) / 100 - 0.5).where((F.col("u") > 1) & (F.col("u") < size - 2)).collect()
    assert len(at) > 1000 and max(abs(r.u - r.value) for r in at) < 1 / 8
