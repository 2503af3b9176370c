"""Tile addresses, tile ranges and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.operators import stats, tiles
from rastertable.plans import adapters as A
from rastertable.plans.registry import query

D = lambda v: f"CAST('{v!r}' AS DOUBLE)"
FULL, HALF = D(geo.CIRCUMFERENCE), D(geo.CIRCUMFERENCE / 2)
PI = D(3.141592653589793)
ZOOMS = (3, 9, 14)


def tile_x_sql(lon, z):
    f, n = f"({lon} / 360.0 + 0.5)", f"power(2.0, {z})"
    return f"(CASE WHEN {f} <= 0 THEN 0 WHEN {f} >= 1 THEN {n} - 1 ELSE floor(({f} + {D(1e-14)}) * {n}) END)"


def tile_y_sql(lat, z):
    s, n = f"sin(radians({lat}))", f"power(2.0, {z})"
    f = f"(0.5 - 0.25 * ln((1 + {s}) / (1 - {s})) / {PI})"
    return f"(CASE WHEN {f} <= 0 THEN 0 WHEN {f} >= 1 THEN {n} - 1 ELSE floor(({f} + {D(1e-14)}) * {n}) END)"


def tile_box_sql(z, x, y):
    size = f"({FULL} / power(2.0, {z}))"
    left, top = f"({x} * {size} - {HALF})", f"({HALF} - {y} * {size})"
    return left, f"({top} - {size})", f"({left} + {size})", top


R = D(6378137.0)
TO_LON, TO_LAT = lambda x: f"degrees({x} / {R})", lambda y: f"degrees(2 * atan(exp({y} / {R})) - {PI} / 2)"


def bounds_sql(crs: str = "EPSG:3857") -> str:
    """g1, box (Mercator) and bounds (degrees) of the embedding rasters."""
    if crs == "EPSG:3857":
        merc = ("l", "b", "r", "t")
        deg = (TO_LON("l"), TO_LAT("b"), TO_LON("r"), TO_LAT("t"))
    else:
        y = lambda v: f"{R} * ln(tan({PI} / 4 + radians({v}) / 2))"
        merc = (f"{R} * radians(l)", y("b"), f"{R} * radians(r)", y("t"))
        deg = ("l", "b", "r", "t")
    return f"""{A.a1_grids_sql(crs)}, own AS (SELECT *, c AS l, f AS t, c + a * width AS r, f + e * height AS b FROM g1),
bounds AS (SELECT scene, width, height, a, c, e, f, {merc[0]} AS ml, {merc[1]} AS mb, {merc[2]} AS mr, {merc[3]} AS mt,
  {deg[0]} AS west, {deg[1]} AS south, {deg[2]} AS east, {deg[3]} AS north FROM own)"""


BOUNDS_SQL = bounds_sql()


def cover_sql(zooms):
    zs = ", ".join(f"({z})" for z in zooms)
    return f"""cover AS (
  SELECT scene, z, x, unnest(range(CAST({tile_y_sql('north', 'z')} AS BIGINT), CAST({tile_y_sql('south', 'z')} AS BIGINT) + 1)) AS y, width, height, a, c, e, f, ml, mb, mr, mt
  FROM (SELECT *, unnest(range(CAST({tile_x_sql('west', 'z')} AS BIGINT), CAST({tile_x_sql('east', 'z')} AS BIGINT) + 1)) AS x
        FROM bounds, (VALUES {zs}) t(z)))"""


@query("tile_index", f"""WITH {A.A5_SQL}
SELECT c_custkey, z, CAST({tile_x_sql('lon', 'z')} AS BIGINT) AS x, CAST({tile_y_sql('lat', 'z')} AS BIGINT) AS y
FROM a5, (VALUES (3), (9), (14)) t(z)""")
def tile_index(spark, d):
    pts = A.a5_points(spark, d).withColumn("z", F.explode(F.array(*[F.lit(z) for z in ZOOMS])))
    return pts.select("c_custkey", "z", geo.tile_x("lon", "z").cast("long").alias("x"), geo.tile_y("lat", "z").cast("long").alias("y"))


_box = tile_box_sql("z", "x", "y")


@query("tile_bounds", f"""WITH {A.A5_SQL}, t AS (
  SELECT c_custkey, 9 AS z, {tile_x_sql('lon', '9')} AS x, {tile_y_sql('lat', '9')} AS y FROM a5)
SELECT c_custkey, round({_box[0]}, 3) AS "left", round({_box[1]}, 3) AS bottom, round({_box[2]}, 3) AS "right", round({_box[3]}, 3) AS top FROM t""")
def tile_bounds(spark, d):
    pts = A.a5_points(spark, d).withColumns({"z": F.lit(9), "x": geo.tile_x("lon", F.lit(9)), "y": geo.tile_y("lat", F.lit(9))})
    return pts.select("c_custkey", *[F.round(c, 3).alias(n) for n, c in geo.tile_bounds("z", "x", "y").items()])


@query("tile_cover", f"WITH {BOUNDS_SQL}, {cover_sql((8, 11, 13))} SELECT scene, z, x, y FROM cover")
def tile_cover(spark, d):
    bounds = stats.geographic_bounds(A.a1_grids(spark, d), A.A1_KEYS)
    return tiles.tile_cover(bounds, (8, 11, 13)).select("scene", "z", "x", "y")


@query("tile_exists", f"""WITH {A.A5_SQL}, {BOUNDS_SQL}, req AS (
  SELECT DISTINCT 's' || CAST(c_custkey % 8 AS VARCHAR) AS scene, z, CAST({tile_x_sql('lon', 'z')} AS BIGINT) AS x, CAST({tile_y_sql('lat', 'z')} AS BIGINT) AS y
  FROM a5, (VALUES (0), (2), (4)) t(z))
SELECT scene, z, x, y, x BETWEEN {tile_x_sql('west', 'z')} AND {tile_x_sql('east', 'z')}
       AND y BETWEEN {tile_y_sql('north', 'z')} AND {tile_y_sql('south', 'z')} AS exists FROM req JOIN bounds USING (scene)""")
def tile_exists(spark, d):
    pts = A.a5_points(spark, d).withColumn("z", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))))
    requests = pts.select(F.concat(F.lit("s"), F.col("c_custkey") % 8).alias("scene"), "z",
                          geo.tile_x("lon", "z").cast("long").alias("x"), geo.tile_y("lat", "z").cast("long").alias("y")).distinct()
    return tiles.tiles_in_bounds(requests, stats.geographic_bounds(A.a1_grids(spark, d), A.A1_KEYS), A.A1_KEYS)


@query("sparse_filter", f"""WITH {BOUNDS_SQL}, {cover_sql((6, 8, 9, 10))},
ratio AS (SELECT scene, z, x, y, (mr - ml) * (mt - mb) / (({FULL} / power(2.0, z)) * ({FULL} / power(2.0, z))) AS v FROM cover)
SELECT scene, z, x, y, round(v, 6) AS cover_ratio, v < 0.01 AS sparse FROM ratio""")
def sparse_filter(spark, d):
    return tiles.sparse_tiles(A.a1_grids(spark, d), A.A1_KEYS, (6, 8, 9, 10)).withColumn("cover_ratio", F.round("cover_ratio", 6))


_NEAR = ("(8.9 + (lon + 180) / 250)", "(47.0 + (lat + 85) / 500)")


@query("tile_datasets", f"""WITH {A.A5_SQL}, {BOUNDS_SQL}, {cover_sql((10, 12))},
wanted AS (SELECT DISTINCT z, CAST({tile_x_sql(_NEAR[0], 'z')} AS BIGINT) AS x, CAST({tile_y_sql(_NEAR[1], 'z')} AS BIGINT) AS y
           FROM a5, (VALUES (10), (12)) t(z))
SELECT scene, z, x, y FROM cover JOIN wanted USING (z, x, y)""")
def tile_datasets(spark, d):
    bounds = stats.geographic_bounds(A.a1_grids(spark, d), A.A1_KEYS)
    pts = A.a5_points(spark, d).withColumn("z", F.explode(F.array(F.lit(10), F.lit(12))))
    lon, lat = (F.expr(e) for e in _NEAR)
    wanted = pts.select("z", geo.tile_x(lon, "z").cast("long").alias("x"), geo.tile_y(lat, "z").cast("long").alias("y"))
    return tiles.tiles_with_datasets(wanted, bounds, A.A1_KEYS, (10, 12)).select("scene", "z", "x", "y")


def _utm_sql():
    """Forward transverse Mercator series for zone 33 north."""
    from rastertable.functions.geo import _ALPHA, _ECC, _RECTIFYING, UTM_SCALE

    e = D(_ECC)
    k = D(UTM_SCALE * _RECTIFYING)
    east = " + ".join(["eta"] + [f"{D(a)} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(_ALPHA, 1)])
    north = " + ".join(["xi"] + [f"{D(a)} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(_ALPHA, 1)])
    return f"""near AS (SELECT c_custkey, 15 + lon / 40 AS lon, lat FROM a5),
s AS (SELECT *, sin(radians(lat)) AS s, radians(lon - 15) AS dl FROM near),
q AS (SELECT *, 0.5 * ln((1 + s) / (1 - s)) - {e} * 0.5 * ln((1 + {e} * s) / (1 - {e} * s)) AS q FROM s),
t AS (SELECT *, (exp(q) - exp(-q)) / 2 AS t FROM q),
xe AS (SELECT *, atan2(t, cos(dl)) AS xi, sin(dl) / sqrt(1 + t * t) AS h FROM t),
xh AS (SELECT *, 0.5 * ln((1 + h) / (1 - h)) AS eta FROM xe)
SELECT c_custkey, round({k} * ({east}) + 500000, 3) AS easting, round({k} * ({north}), 3) AS northing, true AS returns FROM xh"""


@query("utm_projection", f"WITH {A.A5_SQL}, {_utm_sql()}")
def utm_projection(spark, d):
    pts = A.a5_points(spark, d).withColumn("lon", F.lit(15) + F.col("lon") / 40)
    pts = geo.project(pts, geo.WGS84, "EPSG:32633", F.col("lon"), F.col("lat"), "easting", "northing")
    pts = geo.project(pts, "EPSG:32633", geo.WGS84, F.col("easting"), F.col("northing"), "lon_back", "lat_back")
    back = (F.abs(F.col("lon_back") - F.col("lon")) < 1e-7) & (F.abs(F.col("lat_back") - F.col("lat")) < 1e-7)
    return pts.select("c_custkey", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"), back.alias("returns"))


# --- further systems, restated in SQL -------------------------------------------

_ISO = f"(0.5 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) - {D(geo._ECC)} * 0.5 * ln((1 + {D(geo._ECC)} * sin(radians(lat))) / (1 - {D(geo._ECC)} * sin(radians(lat)))))"


def conic_sql(code):
    """x and y of ``lon``, ``lat`` in a conformal conic (or polar stereographic) system."""
    k = {n: D(v) for n, v in geo.CONICS[code].items()}
    turn = f"radians((lon - {k['lon0']} + 540) - 360 * floor((lon - {k['lon0']} + 540) / 360) - 180)"
    rho = f"({k['c']} * exp(-{k['n']} * {_ISO}))"
    return f"({k['x0']} + {rho} * sin({k['n']} * {turn}))", f"({k['y0']} + {k['rho0']} - {rho} * cos({k['n']} * {turn}))"


def equal_area_sql(code):
    """x and y of ``lon``, ``lat`` in an azimuthal equal-area system."""
    k, e = {n: D(v) for n, v in geo.EQUAL_AREAS[code].items()}, D(geo._ECC)
    s = "sin(radians(lat))"
    sb = f"((1 - {e} * {e}) * ({s} / (1 - {e} * {e} * {s} * {s}) + 0.5 * ln((1 + {e} * {s}) / (1 - {e} * {s})) / {e}) / {k['qp']})"
    cb, dl = f"sqrt(1 - {sb} * {sb})", f"radians(lon - {k['lon0']})"
    b = f"({k['r']} * sqrt(2 / (1 + {k['sb']} * {sb} + {k['cb']} * {cb} * cos({dl}))))"
    return (f"({k['x0']} + {b} * {k['d']} * {cb} * sin({dl}))", f"({k['y0']} + {b} / {k['d']} * ({k['cb']} * {sb} - {k['sb']} * {cb} * cos({dl})))")


_PLACES = {  # a region of each system, as lon and lat of the points of A5
    **{code: ("(6 + lon / 20)", "(47 + lat / 20)") for code in ("EPSG:2154", "EPSG:3034", "EPSG:3035")},
    **{code: ("lon", "(75 + lat / 10)") for code in ("EPSG:3413", "EPSG:3995")}, "EPSG:3031": ("lon", "(-75 - lat / 10)")}


def _projected_sql():
    parts = []
    for code, (lon, lat) in sorted(_PLACES.items()):
        x, y = conic_sql(code) if code in geo.CONICS else equal_area_sql(code)
        parts.append(f"SELECT c_custkey, '{code}' AS crs, round({x}, 3) AS x, round({y}, 3) AS y, true AS returns FROM (SELECT c_custkey, {lon} AS lon, {lat} AS lat FROM a5)")
    return f"WITH {A.A5_SQL} " + " UNION ALL ".join(parts)


@query("projections", _projected_sql())
def projections(spark, d):
    """Points in conic, polar stereographic and equal-area systems, and back."""
    pts, parts = A.a5_points(spark, d), []
    for kind, systems in ((geo.CONIC, geo.CONICS), (geo.EQUAL_AREA, geo.EQUAL_AREAS)):
        own = None
        for code in sorted(systems):
            lon, lat = (F.expr(e) for e in _PLACES[code])
            some = pts.select("c_custkey", F.lit(code).alias("crs"), lon.alias("lon"), lat.alias("lat"))
            own = some if own is None else own.unionByName(some)
        out = geo.project(own, geo.WGS84, kind, F.col("lon"), F.col("lat"), "x", "y")
        out = geo.project(out, kind, geo.WGS84, F.col("x"), F.col("y"), "lon_back", "lat_back")
        turned = F.pmod(F.col("lon_back") - F.col("lon") + 180, F.lit(360.0)) - 180
        returns = (F.abs(turned) < 1e-7) & (F.abs(F.col("lat_back") - F.col("lat")) < 1e-7)
        parts.append(out.select("c_custkey", "crs", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), returns.alias("returns")))
    return parts[0].unionByName(parts[1])


def utm_steps_sql(zone, source):
    """Easting ``gx`` and northing ``gy`` of ``lon``, ``lat`` in a northern UTM zone."""
    from rastertable.functions.geo import _ALPHA, _RECTIFYING, UTM_SCALE

    k = D(UTM_SCALE * _RECTIFYING)
    east = " + ".join(["eta"] + [f"{D(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)])
    north = " + ".join(["xi"] + [f"{D(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)])
    return f"""SELECT *, {k} * ({east}) + 500000 AS gx, {k} * ({north}) AS gy FROM (
  SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM (
    SELECT *, sinh({_ISO}) AS t, radians(lon - {zone * 6 - 183}) AS dl FROM {source}))"""


def _utm_bounds_sql():
    """Boxes in degrees from 22 steps along each edge, by the inverse series of zone 37."""
    from rastertable.functions.geo import _BETA, _DELTA, _RECTIFYING, UTM_SCALE

    k = D(UTM_SCALE * _RECTIFYING)
    xi = " - ".join(["xi0"] + [f"{D(b)} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, b in enumerate(_BETA, 1)])
    eta = " - ".join(["eta0"] + [f"{D(b)} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, b in enumerate(_BETA, 1)])
    lat = " + ".join(["chi"] + [f"{D(v)} * sin({2 * j} * chi)" for j, v in enumerate(_DELTA, 1)])
    return f"""WITH {A.a1_grids_sql('EPSG:32637')}, own AS (SELECT scene, c AS l, f AS t, c + a * width AS r, f + e * height AS b FROM g1),
edge AS (SELECT scene, unnest([l + (r - l) * i / 22, l + (r - l) * i / 22, l, r]) AS x, unnest([t, b, b + (t - b) * i / 22, b + (t - b) * i / 22]) AS y
         FROM own, (SELECT CAST(unnest(range(0, 23)) AS DOUBLE) AS i)),
s AS (SELECT scene, {xi} AS xi, {eta} AS eta FROM (SELECT scene, y / {k} AS xi0, (x - 500000) / {k} AS eta0 FROM edge)),
p AS (SELECT scene, degrees(atan2(sinh(eta), cos(xi))) + 39 AS lon, asin(sin(xi) / cosh(eta)) AS chi FROM s)
SELECT scene, round(min(lon), 6) AS west, round(min(degrees({lat})), 6) AS south, round(max(lon), 6) AS east, round(max(degrees({lat})), 6) AS north FROM p GROUP BY 1"""


@query("bounds_utm", _utm_bounds_sql())
def bounds_utm(spark, d):
    b = stats.geographic_bounds(A.a1_grids(spark, d, "EPSG:32637"), A.A1_KEYS)
    return b.select("scene", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])
