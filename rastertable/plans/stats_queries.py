"""Statistics, hulls and bounds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rastertable.operators import hull, percentiles, states, stats
from rastertable.plans import adapters as A
from rastertable.plans.registry import query
from rastertable.sources.cells import pack_blocks
from rastertable.sources.shared import checkpointed, new_folder


def r(c, n=6):
    return F.round(c, n)


def _rounded(df, *keys):
    out = [F.col("n_valid"), r("min").alias("min"), r("max").alias("max"), r("mean").alias("mean"), r("stdev").alias("stdev")]
    return df.select(*keys, *out)


SQL_MOMENTS = """CAST(count(v) AS BIGINT) AS n_valid, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev"""


@query("dataset_stats", f"""
WITH {A.A1_SQL}, {A.a1_grids_sql()}
SELECT s.*, round(n_valid / CAST(width * height AS DOUBLE) * 100, 6) AS valid_percentage FROM (
  SELECT scene, {SQL_MOMENTS}, round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.5), 6) AS p50,
         round(quantile_cont(v, 0.98), 6) AS p98
  FROM (SELECT scene, value AS v FROM a1) GROUP BY 1) s JOIN g1 USING (scene)""")
def dataset_stats(spark, d):
    out = stats.dataset_stats(A.a1_cells(spark, d), A.a1_grids(spark, d), A.A1_KEYS)
    pick = lambda p: r(F.get("percentiles", F.lit(p - 1)))
    return _rounded(out.withColumns({"p2": pick(2), "p50": pick(50), "p98": pick(98)}).withColumn(
        "_vp", r("valid_percentage")), "scene", "p2", "p50", "p98", F.col("_vp").alias("valid_percentage"))


@query("dataset_percentiles", f"""
WITH {A.A2_SQL}, ps AS (SELECT unnest(range(1, 100)) AS p)
SELECT scene, band, CAST(p AS INTEGER) AS p, round(q[p], 6) AS value
FROM (SELECT scene, band, quantile_cont(value, [{', '.join(f'{p / 100}' for p in range(1, 100))}]) AS q FROM a2 GROUP BY 1, 2), ps""")
def dataset_percentiles(spark, d):
    out = percentiles.exact_percentiles(A.a2_cells(spark, d), A.A2_KEYS)
    return out.select("scene", "band", F.posexplode("percentiles").alias("i", "q")).select(
        "scene", "band", (F.col("i") + 1).cast("int").alias("p"), r("q").alias("value"))


REFINED_SQL = f"""
WITH {A.A2_SQL}, ps AS (SELECT unnest(range(1, 100)) AS p)
SELECT scene, band, CAST(p AS INTEGER) AS p, round(q[p], 6) AS value
FROM (SELECT scene, band, quantile_cont(value, [{', '.join(f'{p / 100}' for p in range(1, 100))}]) AS q FROM a2 GROUP BY 1, 2), ps"""


@query("percentiles_refined", REFINED_SQL)
def percentiles_refined(spark, d):
    """Nodes of few pixels, so that histograms are refined several times over."""
    out = percentiles.exact_percentiles(A.a2_cells(spark, d), A.A2_KEYS, node_pixels=200, buckets=64)
    return out.select("scene", "band", F.posexplode("percentiles").alias("i", "q")).select(
        "scene", "band", (F.col("i") + 1).cast("int").alias("p"), r("q").alias("value"))


@query("percentiles_bracketed", REFINED_SQL)
def percentiles_bracketed(spark, d):
    """Percentiles of stored blocks: digests of 64 centroids bracket them, a second scan settles them."""
    grids = A.a2_grids(spark, d).withColumn("nodata", F.lit(None).cast("double"))
    path = new_folder(spark, "blocks")
    pack_blocks(A.a2_cells(spark, d), A.A2_KEYS, 64).write.parquet(path)  # packed once, scanned two or three times
    blocks = spark.read.parquet(path)
    merged = checkpointed(states.merged_states(states.states_of_blocks(blocks, grids, A.A2_KEYS, 64, 64), A.A2_KEYS, 64))
    out = states.exact_percentiles_of_blocks(blocks, grids, A.A2_KEYS, merged, node=100)
    return out.select("scene", "band", F.posexplode("percentiles").alias("i", "q")).select(
        "scene", "band", (F.col("i") + 1).cast("int").alias("p"), r("q").alias("value"))


def _digest_sql(name, source, group, most):
    """Centroids of weighted values (v, w): values that fill a share stay alone, the others are put together by rank."""
    cols = ", ".join(group)
    over = f"PARTITION BY {cols}"
    return f"""{name} AS (
  SELECT {cols}, sum(v * w) / sum(w) AS v, CAST(sum(w) AS BIGINT) AS w FROM (
    SELECT *, CASE WHEN kinds <= {most} THEN nth ELSE least(CAST(floor((cum - CAST(w AS DOUBLE) / 2) / n * {most}) AS BIGINT), {most - 1}) END AS share,
      CASE WHEN kinds <= {most} THEN 0 ELSE count(CASE WHEN w * {most} >= n THEN 1 END) OVER ({over} ORDER BY v) END AS heavy
    FROM (SELECT *, count(*) OVER ({over}) AS kinds, row_number() OVER ({over} ORDER BY v) AS nth,
            CAST(sum(w) OVER ({over}) AS DOUBLE) AS n, CAST(sum(w) OVER ({over} ORDER BY v) AS DOUBLE) AS cum
          FROM (SELECT {cols}, v, sum(w) AS w FROM {source} GROUP BY {cols}, v)))
  GROUP BY {cols}, share, heavy, kinds > {most} AND w * {most} >= n)"""


@query("percentiles_digest", f"""
WITH {A.A1_SQL}, px1 AS (SELECT scene, "row" // 32 AS br, col // 32 AS bc, value AS v, 1 AS w FROM a1),
{_digest_sql("block", "px1", ("scene", "br", "bc"), 50)}, {_digest_sql("merged", "block", ("scene",), 50)},
cum AS (SELECT scene, v, CAST(sum(w) OVER (PARTITION BY scene ORDER BY v) AS BIGINT) AS stop, w, CAST(sum(w) OVER (PARTITION BY scene) AS BIGINT) AS n FROM merged),
at AS (SELECT scene, p, (n - 1) * p // 100 AS a, (n - 1) * p // 100 + CASE WHEN (n - 1) * p % 100 > 0 THEN 1 ELSE 0 END AS z, ((n - 1) * p % 100) / CAST(100 AS DOUBLE) AS f
       FROM (SELECT DISTINCT scene, n FROM cum), range(1, 100) t(p))
SELECT scene, CAST(p AS INTEGER) AS p, round((1 - any_value(f)) * max(CASE WHEN a >= stop - w AND a < stop THEN v END)
  + any_value(f) * max(CASE WHEN z >= stop - w AND z < stop THEN v END), 6) AS value
FROM at JOIN cum USING (scene) GROUP BY 1, 2""".replace("at AS (", "spot AS (").replace("FROM at JOIN", "FROM spot JOIN"))
def percentiles_digest(spark, d):
    """Percentiles from merged digests of 50 centroids alone; the SQL builds the same digests."""
    blocks = pack_blocks(A.a1_cells(spark, d), A.A1_KEYS, 32)
    merged = states.merged_states(states.states_of_blocks(blocks, A.a1_grids(spark, d), A.A1_KEYS, 32, 50), A.A1_KEYS, 50)
    out = states.digest_percentiles(merged, A.A1_KEYS)
    return out.select("scene", F.posexplode("percentiles").alias("i", "q")).select("scene", (F.col("i") + 1).cast("int").alias("p"), r("q").alias("value"))


@query("mask_mixed", f"""
WITH {A.A1_SQL} SELECT scene, "row", col,
  CASE WHEN "row" % 7 = 3 OR "row" % 7 = 4 OR (scene < 's4' AND col % 3 = 0) OR (scene >= 's4' AND "row" % 7 = 5) THEN NULL ELSE value END AS value
FROM a1""")
def mask_mixed(spark, d):
    """Half of the datasets have alpha, the others a nodata value; all hold NaN and infinities."""
    row = F.col("row") % 7
    cells = (A.a1_cells(spark, d)
             .withColumn("value", F.when(row == 3, F.lit(float("nan"))).when(row == 4, F.lit(float("-inf")))
                         .when((row == 5) & (F.col("scene") >= "s4"), F.lit(-99.0)).otherwise(F.col("value")))
             .withColumn("alpha", F.when(F.col("scene") < "s4", (F.col("col") % 3 != 0).cast("int"))))
    grids = A.a1_grids(spark, d).withColumns({
        "has_alpha": F.col("scene") < "s4", "nodata": F.when(F.col("scene") >= "s4", F.lit(-99.0))})
    return stats.masked_cells(cells, grids, A.A1_KEYS).select("scene", "row", "col", "value")


@query("lazy_metadata", f"""
WITH {A.A1_SQL}, {A.a1_grids_sql()}
SELECT scene, {SQL_MOMENTS.replace('CAST(count(v) AS BIGINT) AS n_valid, ', '')} FROM (SELECT scene, value AS v FROM a1) GROUP BY 1""")
def lazy_metadata(spark, d):
    """Statistics of datasets that have none, from all of their pixels."""
    cells, grids = A.a1_cells(spark, d), A.a1_grids(spark, d)
    datasets = grids.select("scene", F.lit("p").alias("path"))
    known = stats.compute_metadata(cells, grids.where("scene = 's0'"), A.A1_KEYS)
    filled = stats.fill_missing(datasets, known, cells, grids, A.A1_KEYS)
    return filled.select("scene", *(r(c).alias(c) for c in ("min", "max", "mean", "stdev")))


def _kept_sql(axis, size, out):
    """Positions of an axis that a decimated read keeps, as a lookup table."""
    return f"(SELECT scene, CAST(((2 * k + 1) * {size}) // (2 * least({size}, {out})) AS INTEGER) AS {axis} FROM g1, range(0, {out}) t(k) WHERE k < least({size}, {out}))"


@query("decimated_stats", f"""
WITH {A.A1_SQL}, {A.a1_grids_sql()}
SELECT scene, {SQL_MOMENTS} FROM (
  SELECT a1.scene, a1.value AS v FROM a1 JOIN {_kept_sql('"row"', 'height', 20)} kr USING (scene, "row")
  JOIN {_kept_sql('col', 'width', 24)} kc USING (scene, col)) GROUP BY 1""")
def decimated_stats(spark, d):
    cells, grids = stats.decimate(A.a1_cells(spark, d), A.a1_grids(spark, d), A.A1_KEYS, (20, 24))
    return _rounded(stats.dataset_stats(cells, grids, A.A1_KEYS, "none"), "scene")


@query("block_stats_merged", f"""
WITH {A.A2_SQL} SELECT scene, band, {SQL_MOMENTS} FROM (SELECT scene, band, value AS v FROM a2) GROUP BY 1, 2""")
def block_stats_merged(spark, d):
    return _rounded(stats.merge_states(stats.block_states(A.a2_cells(spark, d), A.A2_KEYS, 32), A.A2_KEYS), *A.A2_KEYS)


@query("approx_percentiles", f"""
WITH {A.A1_SQL} SELECT scene, CAST(p AS INTEGER) AS p, true AS within
FROM (SELECT DISTINCT scene FROM a1), range(1, 100) t(p)""")
def approx_percentiles(spark, d):
    cells = A.a1_cells(spark, d)
    exact = percentiles.exact_percentiles(cells, A.A1_KEYS).withColumnRenamed("percentiles", "_e")
    both = cells.groupBy("scene").agg(percentiles.approx_percentiles("value").alias("_a"), F.max("value").alias("_max")).join(exact, "scene")
    return both.select("scene", "_max", F.posexplode(F.arrays_zip("_a", "_e")).alias("i", "q")).select(
        "scene", (F.col("i") + 1).cast("int").alias("p"),
        (F.abs(F.col("q._a") - F.col("q._e")) <= F.abs("q._e") * 0.02 + F.col("_max") / 100).alias("within"))


@query("reject_empty", f"""
WITH {A.USER_SQL} SELECT event_type, "user", CAST(count(*) AS BIGINT) AS n_cells FROM au GROUP BY 1, 2
HAVING count(CASE WHEN value <= 5 THEN 1 END) = 0""")
def reject_empty(spark, d):
    cells = A.user_cells(spark, d)
    keys = ["event_type", "user"]
    total = cells.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    grids = total.select(*keys, F.lit(24).alias("width"), F.lit(31).alias("height"))
    masked = cells.withColumn("value", F.when(F.col("value") <= 5, F.col("value")))
    _, rejected = stats.split_empty(stats.dataset_stats(masked, grids, keys, "none"))
    return rejected.select(*keys).join(total, keys)


@query("hull_candidates", f"""
WITH {A.A3_SQL},
ends AS (
  SELECT event_type, "row", min(col) AS col FROM a3 GROUP BY 1, 2 UNION SELECT event_type, "row", max(col) FROM a3 GROUP BY 1, 2
  UNION SELECT event_type, min("row"), col FROM a3 GROUP BY 1, 3 UNION SELECT event_type, max("row"), col FROM a3 GROUP BY 1, 3)
SELECT event_type, "row", col FROM ends""")
def hull_candidates(spark, d):
    return hull.hull_candidates(A.a3_cells(spark, d), A.A3_KEYS)


# a point of the lower (upper) outline is a vertex where the steepest slope
# arriving from the left stays below (above) every slope leaving to the right
_HULL_SQL = f"""
WITH {A.A3_SQL},
corners AS (
  SELECT event_type, min(col) AS lo, max(col) + 1 AS hi, "row" AS y FROM a3 GROUP BY event_type, "row" UNION ALL
  SELECT event_type, min(col), max(col) + 1, "row" + 1 FROM a3 GROUP BY event_type, "row"),
ends AS (SELECT event_type, y, min(lo) AS lo, max(hi) AS hi FROM corners GROUP BY 1, 2),
slopes AS (
  SELECT p.event_type, p.y, p.lo, p.hi,
    max(CASE WHEN q.y < p.y THEN (p.lo - q.lo) / CAST(p.y - q.y AS DOUBLE) END) AS lo_in,
    min(CASE WHEN q.y > p.y THEN (q.lo - p.lo) / CAST(q.y - p.y AS DOUBLE) END) AS lo_out,
    min(CASE WHEN q.y < p.y THEN (p.hi - q.hi) / CAST(p.y - q.y AS DOUBLE) END) AS hi_in,
    max(CASE WHEN q.y > p.y THEN (q.hi - p.hi) / CAST(q.y - p.y AS DOUBLE) END) AS hi_out
  FROM ends p JOIN ends q ON p.event_type = q.event_type AND p.y <> q.y GROUP BY 1, 2, 3, 4)
SELECT event_type, CAST(lo AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM slopes
WHERE lo_in IS NULL OR lo_out IS NULL OR lo_in < lo_out
UNION SELECT event_type, CAST(hi AS BIGINT), CAST(y AS BIGINT) FROM slopes
WHERE hi_in IS NULL OR hi_out IS NULL OR hi_in > hi_out"""


@query("convex_hull", _HULL_SQL)
def convex_hull(spark, d):
    return hull.hull_vertices(A.a3_cells(spark, d), A.A3_KEYS).select("event_type", "x", "y")


_CUT_SQL = """m1 AS (SELECT scene, "row", col FROM a1 WHERE "row" + col >= 12 AND ("row" < 40 OR col < 50))"""


@query("hull_geojson", f"""
WITH {A.a1_grids_sql('EPSG:4326')}, vertices AS ({_HULL_SQL.replace(A.A3_SQL, A.A1_SQL + ", " + _CUT_SQL).replace("FROM a3", "FROM m1").replace("event_type", "scene")})
SELECT scene, round(c + a * x, 6) AS lon, round(f + e * y, 6) AS lat, CAST(count(*) OVER (PARTITION BY scene) + 1 AS INTEGER) AS ring, true AS closed
FROM vertices JOIN g1 USING (scene)""")
def hull_geojson(spark, d):
    """Hulls in degrees read back from their GeoJSON; the ends of raster rows come from block states."""
    cells = A.a1_cells(spark, d).where('`row` + col >= 12 AND (`row` < 40 OR col < 50)')
    grids = A.a1_grids(spark, d, "EPSG:4326")
    found = states.states_of_blocks(pack_blocks(cells, A.A1_KEYS, 16), grids, A.A1_KEYS, 16)
    shapes = hull.convex_hull_of_rows(states.row_ends(checkpointed(found), A.A1_KEYS, 16), grids, A.A1_KEYS)
    ring = F.from_json("convex_hull", "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>")["coordinates"][0]
    rings = shapes.select("scene", ring.alias("ring"))
    points = rings.select("scene", F.size("ring").alias("ring"), (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"),
                          F.explode(F.slice("ring", F.lit(1), F.size("ring") - 1)).alias("pt"))
    return points.select("scene", r(F.col("pt")[0]).alias("lon"), r(F.col("pt")[1]).alias("lat"), "ring", "closed")


_R = "CAST(6378137 AS DOUBLE)"


@query("geographic_bounds", f"""
WITH {A.a1_grids_sql()}, box AS (SELECT scene, c AS l, f AS t, c + a * width AS r, f + e * height AS b FROM g1)
SELECT scene, round(degrees(l / {_R}), 6) AS west, round(degrees(2 * atan(exp(b / {_R})) - pi() / 2), 6) AS south,
       round(degrees(r / {_R}), 6) AS east, round(degrees(2 * atan(exp(t / {_R})) - pi() / 2), 6) AS north FROM box""")
def geographic_bounds(spark, d):
    b = stats.geographic_bounds(A.a1_grids(spark, d), A.A1_KEYS)
    return b.select("scene", *[r(c).alias(c) for c in ("west", "south", "east", "north")])


@query("mask_nodata", f"""
WITH {A.A2_SQL}, {A.A2_GRIDS_SQL}
SELECT a2.scene, a2.band, CAST(count(*) AS BIGINT) AS n_cells,
       CAST(count(CASE WHEN nodata IS NULL OR value <> nodata THEN value END) AS BIGINT) AS n_valid,
       round(min(CASE WHEN nodata IS NULL OR value <> nodata THEN value END), 6) AS min
FROM a2 JOIN g2 USING (scene, band) GROUP BY 1, 2""")
def mask_nodata(spark, d):
    masked = stats.masked_cells(A.a2_cells(spark, d), A.a2_grids(spark, d), A.A2_KEYS)
    return masked.groupBy(*A.A2_KEYS).agg(
        F.count("*").alias("n_cells"), F.count("value").alias("n_valid"), r(F.min("value")).alias("min"))


@query("mask_alpha", f"""
WITH {A.A2_SQL}
SELECT a2.scene, a2.band, a2."row", a2.col, CASE WHEN floor(px.quantity / 11) <> 0 THEN a2.value END AS value
FROM a2 JOIN px USING (scene, "row", col)""")
def mask_alpha(spark, d):
    cells = A.a2_cells(spark, d)
    alpha = cells.where("band = 'quantity'").select("scene", "row", "col", F.floor(F.col("value") / 11).alias("alpha"))
    grids = A.a2_grids(spark, d).withColumns({"nodata": F.lit(None).cast("double"), "has_alpha": F.lit(True)})
    return stats.masked_cells(cells.join(alpha, ["scene", "row", "col"]), grids, A.A2_KEYS).select(
        "scene", "band", "row", "col", "value")


@query("unmasked_audit", f"WITH {A.A2_GRIDS_SQL} SELECT scene, band, nodata IS NULL AS unmasked FROM g2")
def unmasked_audit(spark, d):
    return stats.unmasked_audit(A.a2_grids(spark, d), A.A2_KEYS)
