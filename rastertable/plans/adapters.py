"""The test tables seen as rasters, in Spark and in SQL.

A1  embeddings: one grid per scene (vec_id mod 8), a raster row per vector.
A2  lineitem: scene = return flag, four bands, 128 pixels per raster row, the
    largest value of the lines falling on a pixel; pixels without lines are masked.
A3  events: a grid per event type, user by hour, mean value; sparse.
A4  orders: a catalog of datasets with three keys.
A5  customer: points on the globe.
A6  pages: paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A1_KEYS = ["scene"]
A2_KEYS = ["scene", "band"]
A3_KEYS = ["event_type"]
A4_KEYS = ["status", "priority", "customer"]
BANDS = ("quantity", "price", "discount", "tax")
A2_WIDTH = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def idiv(a, b):
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b))


# --- A1 ---------------------------------------------------------------------

def a1_cells(spark, d) -> DataFrame:
    return embedding_pixels(table(spark, d, "embeddings"))


def embedding_pixels(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.concat(F.lit("s"), F.col("vec_id") % 8).alias("scene"),
        idiv("vec_id", 8).cast("int").alias("row"),
        F.posexplode("embedding").alias("col", "_v"),
    ).select("scene", "row", "col", F.col("_v").cast("double").alias("value"))


def _a1_sizes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").groupBy((F.col("vec_id") % 8).alias("k")).agg(
        F.max(F.size("embedding")).alias("width"), (F.max(idiv("vec_id", 8)) + 1).cast("int").alias("height"))


# fixed values: invented georeferencing, one place per scene
A1_PLACES = {
    "EPSG:3857": dict(a="250.0", c="1000000.3 + 20000.0 * k", e="-250.0", f="6000000.7 - 3000.0 * k"),
    "EPSG:4326": dict(a="0.0025", c="10.0001 + 0.2 * k", e="-0.0025", f="48.0003 - 0.1 * k"),
    "EPSG:3035": dict(a="20.0", c="4321000.0 + 2000.0 * k", e="-20.0", f="3210000.0 - 500.0 * k"),
    "EPSG:32637": dict(a="20.0", c="694920.0 + 2000.0 * k", e="-20.0", f="2055666.0 - 500.0 * k"),
}


def _as_double(text: str) -> str:
    """Decimal literals as doubles in both engines."""
    import re
    return re.sub(r"-?\d+\.\d+", lambda m: f"CAST('{m.group(0)}' AS DOUBLE)", text)


def a1_grids(spark, d, crs: str = "EPSG:3857") -> DataFrame:
    p = {k: F.expr(_as_double(v)) for k, v in A1_PLACES[crs].items()}
    return _a1_sizes(spark, d).select(
        F.concat(F.lit("s"), F.col("k")).alias("scene"), "width", "height",
        p["a"].alias("a"), F.lit(0.0).alias("b"), p["c"].alias("c"),
        F.lit(0.0).alias("d"), p["e"].alias("e"), p["f"].alias("f"),
        F.lit(crs).alias("crs"), F.lit(None).cast("double").alias("nodata"),
        F.lit("float32").alias("dtype"), F.lit(False).alias("has_alpha"))


A1_SQL = """a1 AS (
  SELECT 's' || CAST(vec_id % 8 AS VARCHAR) AS scene, CAST(vec_id // 8 AS INTEGER) AS "row",
         CAST(i - 1 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def a1_grids_sql(crs: str = "EPSG:3857") -> str:
    p = {k: _as_double(v) for k, v in A1_PLACES[crs].items()}
    return f"""g1 AS (
  SELECT 's' || CAST(k AS VARCHAR) AS scene, width, height,
         {p['a']} AS a, {p['c']} AS c, {p['e']} AS e, {p['f']} AS f
  FROM (SELECT vec_id % 8 AS k, CAST(max(len(embedding)) AS INTEGER) AS width,
               CAST(max(vec_id // 8) + 1 AS INTEGER) AS height FROM embeddings GROUP BY 1))"""


# --- A2 ---------------------------------------------------------------------

def a2_cells(spark, d) -> DataFrame:
    pixels = table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("scene"),
        idiv("l_orderkey", A2_WIDTH).cast("int").alias("row"), (F.col("l_orderkey") % A2_WIDTH).cast("int").alias("col"),
    ).agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"),
          F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"))
    return pixels.unpivot(["scene", "row", "col"], list(BANDS), "band", "value").select(
        "scene", "band", "row", "col", "value")


def a2_grids(spark, d) -> DataFrame:
    heights = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scene")).agg(
        (idiv(F.max("l_orderkey"), A2_WIDTH) + 1).cast("int").alias("height"))
    one = lambda name, nodata: F.struct(F.lit(name).alias("band"), F.lit(nodata).cast("double").alias("nodata"))
    bands = F.array(one("quantity", None), one("price", None), one("discount", 0.0), one("tax", 0.0))
    return heights.withColumn("_b", F.explode(bands)).select(
        "scene", F.col("_b.band").alias("band"), F.lit(A2_WIDTH).alias("width"), "height",
        F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), F.lit(500000.0).alias("c"),
        F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), F.lit(6000000.0).alias("f"), F.lit("EPSG:3857").alias("crs"),
        F.col("_b.nodata").alias("nodata"), F.lit("float64").alias("dtype"), F.lit(False).alias("has_alpha"))


A2_SQL = """px AS (
  SELECT l_returnflag AS scene, CAST(l_orderkey // 128 AS INTEGER) AS "row", CAST(l_orderkey % 128 AS INTEGER) AS col,
         max(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) AS discount, max(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2, 3),
a2 AS (
  SELECT scene, 'quantity' AS band, "row", col, quantity AS value FROM px UNION ALL
  SELECT scene, 'price', "row", col, price FROM px UNION ALL
  SELECT scene, 'discount', "row", col, discount FROM px UNION ALL
  SELECT scene, 'tax', "row", col, tax FROM px)"""

A2_GRIDS_SQL = """g2 AS (
  SELECT scene, band, 128 AS width, height, nodata
  FROM (SELECT l_returnflag AS scene, CAST(max(l_orderkey) // 128 + 1 AS INTEGER) AS height FROM lineitem GROUP BY 1)
  JOIN (VALUES ('quantity', NULL), ('price', NULL), ('discount', 0.0), ('tax', 0.0)) b(band, nodata) ON true)"""

A2_META_SQL = """m2 AS (
  SELECT scene, band, count(value) AS n_valid, min(value) AS min, max(value) AS max, avg(value) AS mean,
         stddev_pop(value) AS stdev FROM a2 GROUP BY 1, 2)"""


# --- A3 ---------------------------------------------------------------------

def _hour():
    return (F.datediff("ts", F.lit("2024-01-01")) * 24 + F.hour("ts")).cast("int")


def a3_cells(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(
        "event_type", F.col("user_id").cast("int").alias("row"), _hour().alias("col")).agg(F.avg("value").alias("value"))


A3_SQL = """a3 AS (
  SELECT event_type, CAST(user_id AS INTEGER) AS "row",
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS INTEGER) AS col, avg(value) AS value
  FROM events GROUP BY 1, 2, 3)"""


def user_cells(spark, d) -> DataFrame:
    """A small grid per event type and user: day by hour."""
    return table(spark, d, "events").groupBy(
        "event_type", F.col("user_id").cast("string").alias("user"),
        F.datediff("ts", F.lit("2024-01-01")).alias("row"), F.hour("ts").alias("col")).agg(F.min("value").alias("value"))


USER_SQL = """au AS (
  SELECT event_type, CAST(user_id AS VARCHAR) AS "user",
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS "row", CAST(hour(ts) AS INTEGER) AS col,
         min(value) AS value FROM events GROUP BY 1, 2, 3, 4)"""


# --- A4, A5, A6 -------------------------------------------------------------

def a4_datasets(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.concat(F.lit("/rasters/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path"),
        "o_orderkey", "o_orderdate", "o_totalprice")


A4_SQL = """a4 AS (
  SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer,
         '/rasters/' || o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) || '.tif' AS path,
         o_orderkey, o_orderdate, o_totalprice FROM orders)"""


def a5_points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k, ((k * 137) % 36000 / F.lit(100.0) - F.lit(179.995)).alias("lon"),
        ((k * 89) % 17000 / F.lit(100.0) - F.lit(84.995)).alias("lat"))


A5_SQL = """a5 AS (
  SELECT c_custkey, ((c_custkey * 137) % 36000) / CAST(100 AS DOUBLE) - CAST('179.995' AS DOUBLE) AS lon,
         ((c_custkey * 89) % 17000) / CAST(100 AS DOUBLE) - CAST('84.995' AS DOUBLE) AS lat FROM customer)"""


def a6_paths(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
