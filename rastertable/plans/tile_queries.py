"""Tile layers, previews, reprojection, pyramids and storage layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertable.api import RasterService
from rastertable.operators import layout, overviews, render, stats, tiles
from rastertable.operators import pyramid as Y
from rastertable.operators.catalog import Catalog
from rastertable.plans import adapters as A
from rastertable.plans.geo_queries import PI, R, bounds_sql, cover_sql, equal_area_sql, tile_box_sql, utm_steps_sql
from rastertable.plans.registry import query
from rastertable.plans.render_queries import quantised_sql
from rastertable.sources.cells import pack_blocks, unpack_blocks
from rastertable.sources.shared import new_folder

BLOCK = 16  # small blocks, so the small test rasters span many of them
MASKED_BELOW = -0.15


def _cells(spark, d):
    """A1 with the low values masked."""
    return A.a1_cells(spark, d).withColumn("value", F.when(F.col("value") >= MASKED_BELOW, F.col("value")))


def _blocks(spark, d):
    return pack_blocks(_cells(spark, d), A.A1_KEYS, BLOCK)


CELLS_SQL = f"""{A.A1_SQL}, cells AS MATERIALIZED (SELECT scene, "row", col, value FROM a1 WHERE value >= CAST('{MASKED_BELOW}' AS DOUBLE))"""


# --- the tile definitions restated in SQL ------------------------------------

def frames_sql(crs, zooms, size):
    box = tile_box_sql("z", "x", "y")
    th, tw = size
    res = "(sqrt((mr - ml) * (mr - ml) + (mt - mb) * (mt - mb)) / sqrt(CAST(width * width + height * height AS DOUBLE)))"
    return f"""{bounds_sql(crs)}, {cover_sql(zooms)},
boxed AS (SELECT *, {box[0]} AS fl, {box[1]} AS fb, {box[2]} AS fr, {box[3]} AS ft, {res} AS res FROM cover),
frames AS MATERIALIZED (
  SELECT *, CASE WHEN fine THEN {tw} ELSE greatest(CAST(round_even((fr - fl) / res, 0) AS INTEGER), 1) END AS vw,
            CASE WHEN fine THEN {th} ELSE greatest(CAST(round_even((ft - fb) / res, 0) AS INTEGER), 1) END AS vh,
            {tw} AS tw, {th} AS th
  FROM (SELECT *, ((fr - fl) / {tw} < res OR (ft - fb) / {th} < res) AS fine FROM boxed))"""


def own_frames_sql(crs, size):
    """One frame per dataset: all of it in ``size``, or at its own resolution without a size."""
    res = "(sqrt((mr - ml) * (mr - ml) + (mt - mb) * (mt - mb)) / sqrt(CAST(width * width + height * height AS DOUBLE)))"
    head = f"{bounds_sql(crs)}, boxed AS (SELECT *, 0 AS z, 0 AS x, 0 AS y, {res} AS res FROM bounds)"
    if size is None:
        return f"""{head}, sized AS (SELECT *, CAST(floor((mr - ml) / res + 0.5) AS INTEGER) AS vw,
  CAST(floor((mt - mb) / res + 0.5) AS INTEGER) AS vh FROM boxed),
frames AS (SELECT *, ml AS fl, mt - vh * res AS fb, ml + vw * res AS fr, mt AS ft, vw AS tw, vh AS th, true AS fine FROM sized)"""
    th, tw = size
    return f"""{head}, frames AS MATERIALIZED (
  SELECT *, CASE WHEN fine THEN {tw} ELSE CAST(round_even((mr - ml) / res, 0) AS INTEGER) END AS vw,
            CASE WHEN fine THEN {th} ELSE CAST(round_even((mt - mb) / res, 0) AS INTEGER) END AS vh,
            {tw} AS tw, {th} AS th, ml AS fl, mb AS fb, mr AS fr, mt AS ft
  FROM (SELECT *, ((mr - ml) / {tw} < res OR (mt - mb) / {th} < res) AS fine FROM boxed))"""


def _cubic_sql(t):
    return (f"(CASE WHEN abs({t}) < 1 THEN (1.5 * abs({t}) - 2.5) * {t} * {t} + 1 "
            f"WHEN abs({t}) < 2 THEN (-0.5 * abs({t}) + 2.5) * {t} * {t} - 4 * abs({t}) + 2 ELSE 0 END)")


def _linear_sql(t):
    return f"greatest(1 - abs({t}), 0)"


def warp_sql(crs, method, steps=None):
    """``work``: working pixels with a value. ``steps`` turns a table with lon and lat into one with gx and gy, for systems that need more than one step."""
    inverse = ("mx", "my") if crs == "EPSG:3857" else (
        f"degrees(mx / {R})", f"degrees(2 * atan(exp(my / {R})) - {PI} / 2)")
    source = "pts"
    if steps is not None:
        inverse, source = ("gx", "gy"), f"({steps(f'(SELECT *, degrees(mx / {R}) AS lon, degrees(2 * atan(exp(my / {R})) - {PI} / 2) AS lat FROM pts)')})"
    head = f"""pts AS (
  SELECT *, fl + (vc + 0.5) * ((fr - fl) / vw) AS mx, ft - (vr + 0.5) * ((ft - fb) / vh) AS my
  FROM (SELECT *, unnest(range(0, vw)) AS vc FROM (SELECT *, unnest(range(0, vh)) AS vr FROM frames))),
uv AS MATERIALIZED (SELECT * FROM (SELECT scene, z, x, y, vr, vc, width, height, ({inverse[0]} - c) / a AS u, ({inverse[1]} - f) / e AS v FROM {source})
       WHERE u >= 0 AND u < width AND v >= 0 AND v < height)"""
    if method == "nearest":
        return f"""{head}, work AS (SELECT uv.scene, z, x, y, vr, vc, cells.value AS v FROM uv JOIN cells
  ON cells.scene = uv.scene AND cells."row" = CAST(floor(v) AS INTEGER) AND cells.col = CAST(floor(u) AS INTEGER))"""
    offsets = "(0), (1)" if method == "linear" else "(-1), (0), (1), (2)"
    value, cubic = "CASE WHEN w > 1e-9 THEN wv / w END", ""
    if method == "cubic":
        value = f"CASE WHEN n = 16 THEN cv ELSE {value} END"
        cubic = f", sum({_cubic_sql('du')} * {_cubic_sql('dv')} * value) AS cv, count(*) AS n"
    wl = f"{_linear_sql('du')} * {_linear_sql('dv')}"
    return f"""{head}, spots AS MATERIALIZED (
  SELECT scene, z, x, y, vr, vc, CAST(floor(v - 0.5) AS INTEGER) + dr AS "row", CAST(floor(u - 0.5) AS INTEGER) + dc AS col,
         u - 0.5 - (floor(u - 0.5) + dc) AS du, v - 0.5 - (floor(v - 0.5) + dr) AS dv
  FROM uv, (VALUES {offsets}) ox(dc), (VALUES {offsets}) oy(dr)),
taps AS (SELECT scene, z, x, y, vr, vc, sum({wl}) AS w, sum({wl} * value) AS wv{cubic}
  FROM spots JOIN cells USING (scene, "row", col) GROUP BY 1, 2, 3, 4, 5, 6),
work AS (SELECT * FROM (SELECT scene, z, x, y, vr, vc, {value} AS v FROM taps) WHERE v IS NOT NULL)"""


def reduce_sql(method):
    """``out``: frame pixels out of working pixels, for frames coarser than the source."""
    mid = lambda c, t, q: f"(({c} + 0.5) / {q} - ({t} + 0.5))"
    if method == "average":
        w = lambda c, t, q: f"greatest(0, least(({c} + 1) / {q}, {t} + 1) - greatest({c} / {q}, {t}))"
        reach = 1
    elif method == "nearest":
        w = lambda c, t, q: f"(CASE WHEN CAST(floor(({t} + 0.5) * {q}) AS INTEGER) = {c} THEN 1 ELSE 0 END)"
        reach = 1
    else:
        w = (lambda c, t, q: _linear_sql(mid(c, t, q))) if method == "linear" else (lambda c, t, q: _cubic_sql(mid(c, t, q)))
        reach = 1 if method == "linear" else 2
    return f"""joined AS (SELECT work.*, tw, th, vw / CAST(tw AS DOUBLE) AS rx, vh / CAST(th AS DOUBLE) AS ry FROM work JOIN frames USING (scene, z, x, y)),
spread AS (SELECT *, unnest(range(greatest(0, CAST(floor(vr / ry) AS INTEGER) - {reach}), least(th, CAST(floor(vr / ry) AS INTEGER) + {reach + 1}))) AS py
  FROM (SELECT *, unnest(range(greatest(0, CAST(floor(vc / rx) AS INTEGER) - {reach}), least(tw, CAST(floor(vc / rx) AS INTEGER) + {reach + 1}))) AS px FROM joined)),
sums AS (SELECT scene, z, x, y, py, px, sum(w) AS w, sum(w * v) AS wv,
    max(CASE WHEN CAST(floor((px + 0.5) * rx) AS INTEGER) = vc AND CAST(floor((py + 0.5) * ry) AS INTEGER) = vr THEN 1 ELSE 0 END) AS near
  FROM (SELECT *, {w('vc', 'px', 'rx')} * {w('vr', 'py', 'ry')} AS w FROM spread) GROUP BY 1, 2, 3, 4, 5, 6),
out AS (SELECT scene, z, x, y, CAST(py AS INTEGER) AS py, CAST(px AS INTEGER) AS px, wv / w AS value FROM sums WHERE near = 1 AND abs(w) > 1e-9)"""


FINE_OUT = "out AS (SELECT scene, z, x, y, CAST(vr AS INTEGER) AS py, CAST(vc AS INTEGER) AS px, v AS value FROM work)"
TILE_COLUMNS = "scene, z, x, y, py, px, round(value, 6) AS value"


def tile_sql(crs, zooms, size, warp, reduce=None):
    return (f"WITH {CELLS_SQL}, {frames_sql(crs, zooms, size)}, {warp_sql(crs, warp)}, "
            f"{FINE_OUT if reduce is None else reduce_sql(reduce)} SELECT {TILE_COLUMNS} FROM out")


def _layer(spark, d, crs, zooms, size, **methods):
    out = tiles.tile_layer(_blocks(spark, d), A.a1_grids(spark, d, crs), A.A1_KEYS, zooms, size, block_size=BLOCK, **methods)
    return out.withColumn("value", F.round("value", 6))


def _masked_tile_sql(hole, crs, zooms, size, reduce=None):
    """A tile layer whose cells leave out those for which ``hole`` holds."""
    return tile_sql(crs, zooms, size, "linear", reduce).replace(
        f"WHERE value >= CAST('{MASKED_BELOW}' AS DOUBLE)", f"WHERE value >= CAST('{MASKED_BELOW}' AS DOUBLE) AND NOT ({hole})")


@query("tile_nodata", _masked_tile_sql('("row" + col) % 5 = 0', "EPSG:4326", (13,), (32, 32)))
def tile_nodata(spark, d):
    """A fifth of all stored pixels hold the nodata value, which no tile shows or interpolates with."""
    cells = _cells(spark, d).withColumn("value", F.when((F.col("row") + F.col("col")) % 5 == 0, F.lit(1e6)).otherwise(F.col("value")))
    grids = A.a1_grids(spark, d, "EPSG:4326").withColumn("nodata", F.lit(1e6))
    out = tiles.tile_layer(pack_blocks(cells, A.A1_KEYS, BLOCK), grids, A.A1_KEYS, (13,), (32, 32), block_size=BLOCK)
    return out.withColumn("value", F.round("value", 6))


@query("tile_alpha", _masked_tile_sql('col % 7 = 3 AND scene < \'s4\'', "EPSG:3857", (9,), (32, 32), "average"))
def tile_alpha(spark, d):
    """Every seventh column is transparent; only some grids have alpha."""
    blocks = _blocks(spark, d).withColumn("alpha", F.transform("values", lambda v, i: ((F.col("block_col") * BLOCK + i % BLOCK) % 7 != 3).cast("int")))
    grids = A.a1_grids(spark, d).withColumn("has_alpha", F.col("scene") < "s4")
    out = tiles.tile_layer(blocks, grids, A.A1_KEYS, (9,), (32, 32), block_size=BLOCK)
    return out.withColumn("value", F.round("value", 6))


@query("tile_layer_nearest", tile_sql("EPSG:4326", (13,), (32, 32), "nearest"))
def tile_layer_nearest(spark, d):
    return _layer(spark, d, "EPSG:4326", (13,), (32, 32), preserve_values=True)


@query("tile_layer_linear", tile_sql("EPSG:4326", (13,), (32, 32), "linear"))
def tile_layer_linear(spark, d):
    return _layer(spark, d, "EPSG:4326", (13,), (32, 32))


@query("tile_layer_cubic", tile_sql("EPSG:3857", (13,), (32, 32), "cubic"))
def tile_layer_cubic(spark, d):
    return _layer(spark, d, "EPSG:3857", (13,), (32, 32), reprojection="cubic")


@query("tile_layer_average", tile_sql("EPSG:3857", (9,), (32, 32), "linear", "average"))
def tile_layer_average(spark, d):
    return _layer(spark, d, "EPSG:3857", (9,), (32, 32))


def _listed_tiles(lon, lat, zoom, columns, rows):
    """Tiles of a zoom around a place: those from two to its north-west on."""
    import math

    n = 1 << zoom
    x, y = int((lon / 360 + 0.5) * n), int((0.5 - math.asinh(math.tan(math.radians(lat))) / (2 * math.pi)) * n)
    return [(zoom, x + i, y + j) for i in range(-2, columns) for j in range(-2, rows)]


def _listed_sql(crs, wanted, steps):
    """Tiles of a list, finer than their source."""
    box = tile_box_sql("z", "x", "y")
    frames = f"""{A.a1_grids_sql(crs)}, frames AS MATERIALIZED (
  SELECT *, {box[0]} AS fl, {box[1]} AS fb, {box[2]} AS fr, {box[3]} AS ft, 32 AS vw, 32 AS vh
  FROM g1, (VALUES {', '.join(map(str, wanted))}) t(z, x, y))"""
    # series and closed forms differ in the last digits, which six decimals would show
    return f"WITH {CELLS_SQL}, {frames}, {warp_sql(crs, 'linear', steps)}, {FINE_OUT} SELECT {TILE_COLUMNS.replace('6', '4')} FROM out"


def _listed_layer(spark, d, crs, wanted):
    zoom = wanted[0][0]
    grids = A.a1_grids(spark, d, crs)
    wanted = spark.createDataFrame(wanted, "z int, x long, y long").crossJoin(grids.select("scene"))  # a short list, for a handful of grids
    out = tiles.tile_layer(_blocks(spark, d), grids, A.A1_KEYS, (zoom,), (32, 32), tiles=wanted, block_size=BLOCK)
    return out.withColumn("value", F.round("value", 4))


_UTM_TILES, _AREA_TILES = _listed_tiles(40.847, 18.585, 16, 9, 8), _listed_tiles(10.0, 52.0, 16, 9, 8)


@query("tile_layer_utm", _listed_sql("EPSG:32637", _UTM_TILES, lambda source: utm_steps_sql(37, source)))
def tile_layer_utm(spark, d):
    return _listed_layer(spark, d, "EPSG:32637", _UTM_TILES)


@query("tile_layer_equal_area", _listed_sql("EPSG:3035", _AREA_TILES, lambda source: "SELECT *, {} AS gx, {} AS gy FROM {}".format(*equal_area_sql("EPSG:3035"), source)))
def tile_layer_equal_area(spark, d):
    return _listed_layer(spark, d, "EPSG:3035", _AREA_TILES)


@query("tile_mixed_crs", f"""SELECT * FROM ({tile_sql("EPSG:4326", (13,), (32, 32), "nearest")}) WHERE scene < 's4'
UNION ALL SELECT * FROM ({tile_sql("EPSG:3857", (13,), (32, 32), "nearest")}) WHERE scene >= 's4'""")
def tile_mixed_crs(spark, d):
    """Half of the grids in degrees, half in Web Mercator, in one layer."""
    grids = A.a1_grids(spark, d, "EPSG:4326").where("scene < 's4'").unionByName(A.a1_grids(spark, d, "EPSG:3857").where("scene >= 's4'"))
    out = tiles.tile_layer(_blocks(spark, d), grids, A.A1_KEYS, (13,), (32, 32), block_size=BLOCK, preserve_values=True)
    return out.withColumn("value", F.round("value", 6))


def _preview_sql(method):
    return (f"WITH {CELLS_SQL}, {own_frames_sql('EPSG:3857', (24, 20))}, {warp_sql('EPSG:3857', 'nearest')}, {reduce_sql(method)} "
            "SELECT scene, py, px, round(value, 6) AS value FROM out")


def _preview(spark, d, method):
    # the working grid is the source grid here, so this shows the second step alone
    out = tiles.previews(_blocks(spark, d), A.a1_grids(spark, d), A.A1_KEYS, (24, 20),
                         block_size=BLOCK, reprojection="nearest", resampling=method)
    return out.withColumn("value", F.round("value", 6))


@query("resample_nearest", _preview_sql("nearest"))
def resample_nearest(spark, d):
    return _preview(spark, d, "nearest")


@query("resample_average", _preview_sql("average"))
def resample_average(spark, d):
    return _preview(spark, d, "average")


@query("resample_linear", _preview_sql("linear"))
def resample_linear(spark, d):
    return _preview(spark, d, "linear")


@query("resample_cubic", _preview_sql("cubic"))
def resample_cubic(spark, d):
    return _preview(spark, d, "cubic")


@query("tile_preview", f"WITH {CELLS_SQL}, {own_frames_sql('EPSG:4326', (16, 16))}, {warp_sql('EPSG:4326', 'linear')}, {reduce_sql('average')} "
                       "SELECT scene, py, px, round(value, 6) AS value FROM out")
def tile_preview(spark, d):
    out = tiles.previews(_blocks(spark, d), A.a1_grids(spark, d, "EPSG:4326"), A.A1_KEYS, (16, 16), block_size=BLOCK)
    return out.withColumn("value", F.round("value", 6))


@query("reprojected", f"WITH {CELLS_SQL}, {own_frames_sql('EPSG:4326', None)}, {warp_sql('EPSG:4326', 'linear')} "
                      'SELECT scene, CAST(vr AS INTEGER) AS "row", CAST(vc AS INTEGER) AS col, round(v, 6) AS value FROM work')
def reprojected(spark, d):
    cells, _ = tiles.reproject(_blocks(spark, d), A.a1_grids(spark, d, "EPSG:4326"), A.A1_KEYS, block_size=BLOCK)
    return cells.withColumn("value", F.round("value", 6))


@query("empty_tiles", f"""WITH {CELLS_SQL}, {frames_sql('EPSG:3857', (9, 11), (8, 8))}, {warp_sql('EPSG:3857', 'nearest')},
{reduce_sql('nearest')}, wanted AS (SELECT DISTINCT scene, z, x + dx AS x, y FROM cover, (VALUES (0), (1)) t(dx)),
px AS (SELECT scene, z, x, y, unnest(range(0, 8)) AS px, py FROM (SELECT *, unnest(range(0, 8)) AS py FROM wanted))
SELECT px.scene, px.z, px.x, px.y, CAST(px.py AS INTEGER) AS py, CAST(px.px AS INTEGER) AS px, coalesce(value, 0) AS value
FROM px LEFT JOIN out ON px.scene = out.scene AND px.z = out.z AND px.x = out.x AND px.y = out.y AND px.py = out.py AND px.px = out.px""")
def empty_tiles(spark, d):
    grids = A.a1_grids(spark, d)
    pixels = tiles.tile_layer(_blocks(spark, d), grids, A.A1_KEYS, (9, 11), (8, 8), block_size=BLOCK, preserve_values=True)
    cover = tiles.tile_cover(stats.geographic_bounds(grids, A.A1_KEYS), (9, 11))
    wanted = cover.select("scene", "z", F.explode(F.array(F.col("x"), F.col("x") + 1)).alias("x"), "y")
    return tiles.complete_tiles(wanted, pixels, A.A1_KEYS, (8, 8), fill=0.0)


@query("rendered_layer", f"""WITH {CELLS_SQL}, {frames_sql('EPSG:3857', (13,), (32, 32))}, {warp_sql('EPSG:3857', 'nearest')}, {FINE_OUT},
m AS (SELECT scene, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1),
q AS (SELECT scene, z, x, y, py, px, {quantised_sql('value', 'lo', 'hi')} AS index FROM out JOIN m USING (scene))
SELECT *, index AS r, index AS g, index AS b, CASE WHEN index = 0 THEN 0 ELSE 255 END AS a FROM q""")
def rendered_layer(spark, d):
    pixels = tiles.tile_layer(_blocks(spark, d), A.a1_grids(spark, d), A.A1_KEYS, (13,), (32, 32), block_size=BLOCK,
                              reprojection="nearest")
    meta = stats.moments(_cells(spark, d), A.A1_KEYS).withColumn("percentiles", F.lit(None).cast("array<double>"))
    return render.singleband(pixels, meta, A.A1_KEYS, at=[*tiles.TILE_IDS, "py", "px"])


# --- pyramids ------------------------------------------------------------------

DEEP_SQL = f"""{CELLS_SQL}, {A.a1_grids_sql()}, deep AS (
  SELECT *, CAST(ceil(log2(greatest(height // {BLOCK}, width // {BLOCK}, 1))) AS INTEGER) AS levels FROM g1)"""


@query("pyramid", f"""WITH {DEEP_SQL}
SELECT scene, level, CAST("row" // (1 << level) AS INTEGER) AS "row", CAST(col // (1 << level) AS INTEGER) AS col, round(avg(value), 6) AS value
FROM (SELECT scene, "row", col, value, CAST(unnest(range(1, levels + 1)) AS INTEGER) AS level FROM cells JOIN deep USING (scene)) GROUP BY 1, 2, 3, 4""")
def pyramid(spark, d):
    return _pyramid(spark, d, "average")


def _pyramid(spark, d, method):
    out = Y.pyramid(_cells(spark, d), A.a1_grids(spark, d), A.A1_KEYS, method, BLOCK)
    return out.withColumn("value", F.round("value", 6))


@query("pyramid_nearest", f"""WITH {DEEP_SQL}
SELECT scene, level, CAST("row" // (1 << level) AS INTEGER) AS "row", CAST(col // (1 << level) AS INTEGER) AS col, round(value, 6) AS value
FROM (SELECT scene, "row", col, value, CAST(unnest(range(1, levels + 1)) AS INTEGER) AS level FROM cells JOIN deep USING (scene))
WHERE "row" % (1 << level) = 0 AND col % (1 << level) = 0""")
def pyramid_nearest(spark, d):
    return _pyramid(spark, d, "nearest")


def _kernel_pyramid_sql(weight, radius, top=5):
    """Every level out of the one before; ``top`` levels cover the test rasters."""
    parts, previous = [], "(SELECT scene, \"row\", col, value FROM cells)"
    for n in range(1, top + 1):
        t = lambda c, q: f"((p.{c} + 0.5) / 2 - 0.5 - {q})"
        near = lambda c, size: (f"unnest(range(greatest(0, CAST(ceil((p.{c} + 0.5) / 2 - 0.5 - {radius}) AS INTEGER)), "
                                f"least(CAST(floor((p.{c} + 0.5) / 2 - 0.5 + {radius}) AS INTEGER) + 1, CAST(ceil({size} / CAST({1 << n} AS DOUBLE)) AS INTEGER))))")
        parts.append(f"""l{n} AS (SELECT scene, tr AS "row", tc AS col, sum(w * value) / sum(w) AS value FROM (
  SELECT p.scene, p.value, tr, tc, {weight(t('"row"', 'tr'))} * {weight(t('col', 'tc'))} AS w FROM (
    SELECT p.*, {near('col', 'width')} AS tc FROM (SELECT p.*, width, {near('"row"', 'height')} AS tr
      FROM {previous} p JOIN deep USING (scene) WHERE levels >= {n}) p) p) GROUP BY 1, 2, 3 HAVING abs(sum(w)) > 1e-9)""")
        previous = f"l{n}"
    rows = " UNION ALL ".join(
        f'SELECT scene, {n} AS level, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(value, 6) AS value FROM l{n}'
        for n in range(1, top + 1))
    return f"WITH {DEEP_SQL}, {', '.join(parts)} {rows}"


@query("pyramid_bilinear", _kernel_pyramid_sql(_linear_sql, 1))
def pyramid_bilinear(spark, d):
    return _pyramid(spark, d, "bilinear")


@query("pyramid_cubic", _kernel_pyramid_sql(_cubic_sql, 2))
def pyramid_cubic(spark, d):
    return _pyramid(spark, d, "cubic")


@query("pyramid_nodata", f"""WITH {DEEP_SQL}
SELECT scene, level, CAST("row" // (1 << level) AS INTEGER) AS "row", CAST(col // (1 << level) AS INTEGER) AS col, round(avg(value), 6) AS value
FROM (SELECT scene, "row", col, value, CAST(unnest(range(1, levels + 1)) AS INTEGER) AS level FROM cells JOIN deep USING (scene)
      WHERE ("row" + col) % 5 <> 0) GROUP BY 1, 2, 3, 4""")
def pyramid_nodata(spark, d):
    """A fifth of all pixels hold the nodata value, which no overview averages in."""
    hole = (F.col("row") + F.col("col")) % 5 == 0
    cells = _cells(spark, d).withColumn("value", F.when(hole, F.lit(1e6)).otherwise(F.col("value")))
    grids = A.a1_grids(spark, d).withColumn("nodata", F.lit(1e6))
    out = Y.pyramid(cells, grids, A.A1_KEYS, "average", BLOCK)
    return out.select("scene", "level", "row", "col", F.round("value", 6).alias("value"))


def _overview_cells(spark, d, method):
    """Overviews made inside blocks of 4 x 4, so that several rounds of levels are needed, spelled out as cells."""
    blocks = pack_blocks(_cells(spark, d), A.A1_KEYS, 4)
    made = overviews.overview_blocks(blocks, A.a1_grids(spark, d), A.A1_KEYS, method, 4)
    return unpack_blocks(made, [*A.A1_KEYS, "level"], 4).where("value IS NOT NULL").select("scene", "level", "row", "col", F.round("value", 6).alias("value"))


_SMALL_DEEP = DEEP_SQL.replace(f"// {BLOCK}", "// 4")


@query("pyramid_blocks", f"""WITH {_SMALL_DEEP}
SELECT scene, level, CAST("row" // (1 << level) AS INTEGER) AS "row", CAST(col // (1 << level) AS INTEGER) AS col, round(avg(value), 6) AS value
FROM (SELECT scene, "row", col, value, CAST(unnest(range(1, levels + 1)) AS INTEGER) AS level FROM cells JOIN deep USING (scene)) GROUP BY 1, 2, 3, 4""")
def pyramid_blocks(spark, d):
    return _overview_cells(spark, d, "average")


@query("pyramid_blocks_nearest", f"""WITH {_SMALL_DEEP}
SELECT scene, level, CAST("row" // (1 << level) AS INTEGER) AS "row", CAST(col // (1 << level) AS INTEGER) AS col, round(value, 6) AS value
FROM (SELECT scene, "row", col, value, CAST(unnest(range(1, levels + 1)) AS INTEGER) AS level FROM cells JOIN deep USING (scene))
WHERE "row" % (1 << level) = 0 AND col % (1 << level) = 0""")
def pyramid_blocks_nearest(spark, d):
    return _overview_cells(spark, d, "nearest")


def _stored(spark, d, crs):
    """A1 with nodata and alpha, written as a clustered table with masks."""
    hole = (F.col("row") + F.col("col")) % 5 == 0
    cells = _cells(spark, d).withColumn("value", F.when(hole, F.lit(1e6)).otherwise(F.col("value")))
    blocks = pack_blocks(cells, A.A1_KEYS, BLOCK).withColumn("alpha", F.transform("values", lambda v, i: ((F.col("block_row") * BLOCK + F.floor(i / BLOCK)) >= 4).cast("int")))
    grids = A.a1_grids(spark, d, crs).withColumns({"nodata": F.lit(1e6), "has_alpha": F.col("scene") == "s1"})
    path = new_folder(spark, "blocks")
    layout.write_blocks(blocks, grids, A.A1_KEYS, path, files=4)
    return path, grids


_HOLES = '("row" + col) % 5 = 0 OR (scene = \'s1\' AND "row" < 4)'


@query("tiled_written", f"""WITH {CELLS_SQL}
SELECT scene, "row", col, round(value, 6) AS value FROM cells WHERE NOT ({_HOLES})""")
def tiled_written(spark, d):
    """Blocks written with their masks and read back as cells."""
    path, _ = _stored(spark, d, "EPSG:3857")
    return unpack_blocks(layout.read_blocks(spark, path), A.A1_KEYS, BLOCK).where("value IS NOT NULL").select("scene", "row", "col", F.round("value", 6).alias("value"))


@query("tile_from_store", tile_sql("EPSG:4326", (13,), (32, 32), "linear").replace(
    f"WHERE value >= CAST('{MASKED_BELOW}' AS DOUBLE)", f"WHERE value >= CAST('{MASKED_BELOW}' AS DOUBLE) AND NOT ({_HOLES})") + " WHERE (x + y) % 3 = 0")
def tile_from_store(spark, d):
    """Every third tile of a zoom, from the stored blocks that those tiles read alone."""
    path, grids = _stored(spark, d, "EPSG:4326")
    cover = tiles.tile_cover(stats.geographic_bounds(grids, A.A1_KEYS), (13,)).where("(x + y) % 3 = 0")
    frames = tiles.tile_frames(grids, A.A1_KEYS, (13,), (32, 32), tiles=cover)
    blocks = layout.read_for_frames(spark, path, frames, A.A1_KEYS, tiles.TILE_IDS, block_size=BLOCK)
    out = tiles.tile_layer(blocks, grids.drop("nodata", "has_alpha"), A.A1_KEYS, (13,), (32, 32), tiles=cover, block_size=BLOCK)
    return out.withColumn("value", F.round("value", 6))


def _service(spark, d, crs, blocks):
    """A service over a catalog that holds no statistics yet."""
    grids = A.a1_grids(spark, d, crs)
    catalog = Catalog.create(spark, A.A1_KEYS).insert(grids.select("scene", F.concat(F.lit("/"), "scene").alias("path")))
    return RasterService(catalog, blocks, grids, BLOCK, tile_size=(32, 32))


_LEVEL_GRIDS = """), g1 AS (SELECT scene, CAST((width + 1) // 2 AS INTEGER) AS width, CAST((height + 1) // 2 AS INTEGER) AS height, a * 2 AS a, c, e * 2 AS e, f FROM g0),"""


def _level_sql():
    """Tiles of zoom 11 out of the first overview level, which is the coarsest one that is as fine as they are."""
    sql = tile_sql("EPSG:3857", (11,), (32, 32), "linear", "average").replace("cells AS MATERIALIZED", "base AS MATERIALIZED", 1)
    head, tail = sql.split("g1 AS (", 1)
    grids, rest = tail.split("GROUP BY 1)", 1)
    cells = 'cells AS MATERIALIZED (SELECT scene, CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, avg(value) AS value FROM base GROUP BY 1, 2, 3)'
    return f"{head}{cells}, g0 AS ({grids}GROUP BY 1){_LEVEL_GRIDS} {rest.removeprefix(')').lstrip(', ')}"


@query("tile_from_overviews", _level_sql())
def tile_from_overviews(spark, d):
    """A low zoom from a stored table with overviews, through the service."""
    blocks, grids = _blocks(spark, d), A.a1_grids(spark, d)
    levels = overviews.overview_blocks(blocks, grids, A.A1_KEYS, "average", BLOCK)
    base = blocks.withColumn("level", F.lit(0))
    path = new_folder(spark, "levels")
    layout.write_blocks(base.unionByName(levels.select(*base.columns)), grids, A.A1_KEYS, path, files=4)
    wanted = tiles.tile_cover(stats.geographic_bounds(grids, A.A1_KEYS), (11,)).select("z", "x", "y").distinct()
    pixels, at = _service(spark, d, "EPSG:3857", path).pixels(None, wanted)
    return pixels.select("scene", *at, F.round("value", 6).alias("value"))


@query("service_tiles", f"""WITH {CELLS_SQL}, {frames_sql('EPSG:3857', (13,), (32, 32))}, {warp_sql('EPSG:3857', 'linear')}, {FINE_OUT},
m AS (SELECT scene, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1),
q AS (SELECT scene, z, x, y, py, px, {quantised_sql('value', 'lo', 'hi')} AS index FROM out JOIN m USING (scene)),
asked AS (SELECT DISTINCT z, x, y FROM cover WHERE scene = 's1' AND (x + y) % 2 = 0 UNION SELECT 13, 0, 0),
image AS (SELECT s.scene, asked.*, unnest(range(0, 32)) AS px FROM asked, (VALUES ('s1'), ('s2')) s(scene)),
px AS (SELECT *, unnest(range(0, 32)) AS py FROM image)
SELECT scene, CAST(px.z AS INTEGER) AS z, CAST(px.x AS BIGINT) AS x, CAST(px.y AS BIGINT) AS y, CAST(px.py AS INTEGER) AS py, CAST(px.px AS INTEGER) AS px,
  coalesce(index, 0) AS index, coalesce(index, 0) AS r, coalesce(index, 0) AS g, coalesce(index, 0) AS b, CASE WHEN coalesce(index, 0) = 0 THEN 0 ELSE 255 END AS a
FROM px LEFT JOIN q USING (scene, z, x, y, py, px)""")
def service_tiles(spark, d):
    """Complete tiles of two datasets, also where these do not reach; their statistics are computed on the way."""
    service = _service(spark, d, "EPSG:3857", _blocks(spark, d))
    bounds = stats.geographic_bounds(A.a1_grids(spark, d).where("scene = 's1'"), A.A1_KEYS)
    wanted = tiles.tile_cover(bounds, (13,)).where("(x + y) % 2 = 0").select(F.col("z").cast("int").alias("z"), "x", "y")
    wanted = wanted.unionByName(spark.sql("SELECT 13 AS z, 0L AS x, 0L AS y")).distinct()
    return service.singleband({"scene": ["s1", "s2"]}, wanted, complete=True)


@query("tile_request", f"""WITH {CELLS_SQL}, {frames_sql('EPSG:4326', (3, 12, 16), (8, 8))}
SELECT scene, z, x, y FROM frames WHERE (x + y) % 2 = 0""")
def tile_request(spark, d):
    """Every second tile of some zooms, and the datasets under it, without the cover of the datasets."""
    grids = A.a1_grids(spark, d, "EPSG:4326")
    bounds = stats.geographic_bounds(grids, A.A1_KEYS)
    wanted = tiles.tile_cover(bounds, (3, 12, 16)).where("(x + y) % 2 = 0").select("z", "x", "y").distinct()
    return tiles.tiles_with_datasets(wanted, bounds, A.A1_KEYS, (3, 12, 16)).select("scene", "z", "x", "y")


@query("tiled_layout", f"""WITH {CELLS_SQL}
SELECT scene, 0 AS level, CAST("row" // {BLOCK} AS INTEGER) AS block_row, CAST(col // {BLOCK} AS INTEGER) AS block_col,
       {BLOCK * BLOCK} AS n_pixels, CAST(count(*) AS BIGINT) AS n_valid, round(sum(value), 6) AS total FROM cells GROUP BY 1, 2, 3, 4""")
def tiled_layout(spark, d):
    blocks = Y.tiled_blocks(_cells(spark, d), A.A1_KEYS, BLOCK)
    valid = F.filter("values", lambda v: ~F.isnan(v))
    return blocks.select(
        "scene", "level", "block_row", "block_col", F.size("values").alias("n_pixels"), F.size(valid).cast("long").alias("n_valid"),
        F.round(F.aggregate(valid, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# the audit sees A2 stretched to rasters above 512 pixels by their block size;
# the bands of one scene lose their overviews to show failing datasets
@query("layout_audit", f"""WITH {A.A2_SQL.split(',' + chr(10) + 'a2 AS')[0]}
SELECT scene, band, scene = 'N' AS missing, scene <> 'N' AS valid FROM (SELECT DISTINCT scene FROM px), (VALUES {', '.join(f"('{b}')" for b in A.BANDS)}) t(band)""")
def layout_audit(spark, d):
    cells = A.a2_cells(spark, d).select(*A.A2_KEYS, (F.col("row") * 16).alias("row"), (F.col("col") * 5).alias("col"), "value")
    grids = cells.groupBy(*A.A2_KEYS).agg((F.max("row") + 640).alias("height")).select(*A.A2_KEYS, F.lit(640).alias("width"), "height")
    made = overviews.overview_blocks(pack_blocks(cells, A.A2_KEYS, 64), grids, A.A2_KEYS, "average", 64).where("NOT (scene = 'N' AND level > 1)")
    place = lambda c: F.floor(F.col(c) / 64).alias(f"block_{c}")
    base = cells.select(*A.A2_KEYS, F.lit(0).alias("level"), place("row"), place("col")).distinct()
    index = base.unionByName(made.select(*base.columns))
    audit = Y.layout_audit(index, grids, A.A2_KEYS, 64)
    return audit.select(*A.A2_KEYS, (F.size("warnings") > 0).alias("missing"), "valid")
