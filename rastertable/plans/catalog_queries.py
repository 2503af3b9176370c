"""Catalog search, metadata requests, changes and path patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertable.operators import catalog as cat
from rastertable.operators import stats
from rastertable.plans import adapters as A
from rastertable.plans.registry import query
from rastertable.sources import paths as P
from rastertable.sources.catalog_log import CatalogLog
from rastertable.sources.shared import new_folder

KEYS = A.A4_KEYS
SPLIT = "1998-01-01"  # orders from this day on play the part of new arrivals
LAST_SQL = """SELECT status, priority, customer, path FROM (
    SELECT *, row_number() OVER (PARTITION BY status, priority, customer ORDER BY o_orderkey DESC) AS rn FROM {}) WHERE rn = 1"""
BASE_SQL = f"""{A.A4_SQL},
old AS (SELECT * FROM a4 WHERE o_orderdate < DATE '{SPLIT}'), new AS (SELECT * FROM a4 WHERE o_orderdate >= DATE '{SPLIT}'),
base AS ({LAST_SQL.format('old')}), arrived AS ({LAST_SQL.format('new')})"""


def _halves(spark, d):
    """The catalog before SPLIT (one dataset per key) and the rows arriving after."""
    orders = A.a4_datasets(spark, d)
    cols = [*KEYS, "path", "o_orderkey"]
    day = F.lit(SPLIT).cast("timestamp_ntz")
    old, new = orders.where(F.col("o_orderdate") < day).select(*cols), orders.where(F.col("o_orderdate") >= day).select(*cols)
    return cat.last_per_key(old, KEYS, "o_orderkey").drop("o_orderkey"), new


def _datasets(spark, d):
    return A.a4_datasets(spark, d).select(*KEYS, "path")


@query("dataset_search", f"""WITH {A.A4_SQL}
SELECT status, priority, customer, path FROM a4 WHERE status IN ('O', 'F') AND priority = '1-URGENT'""")
def dataset_search(spark, d):
    return cat.search(_datasets(spark, d), KEYS, {"status": ["O", "F"], "priority": "1-URGENT"})


@query("dataset_search_positional", f"""WITH {A.A4_SQL}
SELECT status, priority, customer, path FROM a4 WHERE status = 'P' AND priority IN ('5-LOW', '2-HIGH')""")
def dataset_search_positional(spark, d):
    return cat.search(_datasets(spark, d), KEYS, ["P", ["5-LOW", "2-HIGH"]])


@query("dataset_page", f"""WITH {A.A4_SQL}
SELECT status, priority, customer, path FROM a4 ORDER BY status, priority, customer, path LIMIT 100 OFFSET 300""")
def dataset_page(spark, d):
    return cat.page_of(_datasets(spark, d), KEYS, page=3, limit=100)


@query("key_list", """
SELECT 'k' || CAST(r_regionkey AS VARCHAR) AS key_name, CASE WHEN length(r_name) > 4 THEN r_name END AS description FROM region""")
def key_list(spark, d):
    described = F.when(F.length("r_name") > 4, F.col("r_name")).otherwise(F.lit(""))
    table = A.table(spark, d, "region").select(
        F.concat(F.lit("k"), "r_regionkey").alias("key_name"), described.alias("description"), F.col("r_regionkey").alias("idx"))
    return cat.list_keys(table)


def _metadata(spark, d):
    return stats.dataset_stats(A.a2_cells(spark, d), A.a2_grids(spark, d), A.A2_KEYS, "none")


@query("metadata_columns", f"""WITH {A.A2_SQL}, {A.A2_META_SQL}
SELECT scene, band, min, max, round(mean, 6) AS mean FROM m2""")
def metadata_columns(spark, d):
    out = cat.metadata_columns(_metadata(spark, d), A.A2_KEYS, ["min", "max", "mean"])
    return out.select("keys.scene", "keys.band", "min", "max", F.round("mean", 6).alias("mean"))


@query("metadata_lookup", f"""WITH {A.A2_SQL}, {A.A2_META_SQL}
SELECT scene, band, min, max, round(stdev, 6) AS stdev FROM m2 WHERE scene = 'R' AND band = 'tax'""")
def metadata_lookup(spark, d):
    out = cat.metadata_of(_metadata(spark, d), A.A2_KEYS, ("R", "tax"))
    return out.select("scene", "band", "min", "max", F.round("stdev", 6).alias("stdev"))


@query("metadata_batch", f"""WITH {A.A2_SQL}, {A.A2_META_SQL},
req AS (SELECT o_orderkey AS ordinal, o_orderstatus AS s,
  CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'R' ELSE 'X' END AS scene,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'price' ELSE 'tax' END AS band FROM orders)
SELECT ordinal, req.scene, req.band, min, max, round(mean, 6) AS mean, m2.scene IS NOT NULL AS found
FROM req LEFT JOIN m2 ON req.scene = m2.scene AND req.band = m2.band""")
def metadata_batch(spark, d):
    o = A.table(spark, d, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderstatus") == "O", F.lit("A")).when(F.col("o_orderstatus") == "F", F.lit("R")).otherwise(F.lit("X")).alias("scene"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("price")).otherwise(F.lit("tax")).alias("band"))
    out = cat.metadata_batch(requests, _metadata(spark, d), A.A2_KEYS, ["min", "max", "mean"], on_missing="null")
    return out.select("ordinal", "keys.scene", "keys.band", "min", "max", F.round("mean", 6).alias("mean"), "found")


@query("metadata_missing", f"""WITH {BASE_SQL}
SELECT DISTINCT a4.status, a4.priority, a4.customer FROM a4 WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.status = a4.status AND b.priority = a4.priority AND b.customer = a4.customer)""")
def metadata_missing(spark, d):
    known, _ = _halves(spark, d)
    everything = _datasets(spark, d).select(*KEYS).distinct()
    return cat.without_metadata(everything, known.select(*KEYS), KEYS)


@query("metadata_roundtrip", f"""WITH {A.A2_SQL}, {A.A2_META_SQL}
SELECT scene, band, min, max, round(mean, 6) AS mean, round(CAST(CAST(mean AS FLOAT) AS DOUBLE), 4) AS p1,
       'x' || scene AS note FROM m2""")
def metadata_roundtrip(spark, d):
    decoded = _metadata(spark, d).select(
        *A.A2_KEYS, F.struct(F.lit(1.0).alias("west"), F.lit(2.0).alias("south"), F.lit(3.0).alias("east"), F.lit(4.0).alias("north")).alias("bounds"),
        F.struct(F.lit("Polygon").alias("type")).alias("convex_hull"), "valid_percentage", F.struct("min", "max").alias("range"),
        "mean", "stdev", F.array("mean").alias("percentiles"), F.struct(F.concat(F.lit("x"), "scene").alias("note")).alias("metadata"))
    back = cat.decode_metadata(cat.encode_metadata(decoded, A.A2_KEYS), A.A2_KEYS)
    return back.select(
        *A.A2_KEYS, "range.min", "range.max", F.round("mean", 6).alias("mean"),
        F.round(F.get("percentiles", F.lit(0)), 4).alias("p1"),
        F.try_variant_get("metadata", "$.note", "string").alias("note"))


@query("catalog_upsert", f"""WITH {BASE_SQL}
SELECT * FROM arrived UNION ALL
SELECT * FROM base WHERE (status, priority, customer) NOT IN (SELECT (status, priority, customer) FROM arrived)""")
def catalog_upsert(spark, d):
    base, new = _halves(spark, d)
    return cat.upsert(base, new, KEYS, order="o_orderkey")


@query("catalog_delete", f"""WITH {BASE_SQL}
SELECT * FROM base WHERE (status, priority, customer) NOT IN (SELECT (status, priority, customer) FROM arrived)""")
def catalog_delete(spark, d):
    base, new = _halves(spark, d)
    return cat.remove(base, new, KEYS)


@query("append_new", f"""WITH {BASE_SQL}
SELECT * FROM arrived WHERE (status, priority, customer) NOT IN (SELECT (status, priority, customer) FROM base)""")
def append_new(spark, d):
    base, new = _halves(spark, d)
    return cat.only_new(cat.last_per_key(new, KEYS, "o_orderkey").drop("o_orderkey"), base, KEYS)


@query("key_reorder", f"WITH {A.A4_SQL} SELECT priority, customer, status, path FROM a4")
def key_reorder(spark, d):
    order = P.move_key_last(KEYS, "status")
    return _datasets(spark, d).select(*order, "path")


@query("path_override", f"""WITH {A.A4_SQL}
SELECT status, priority, customer, CASE WHEN o_totalprice > 200000 THEN '/archive' || path ELSE path END AS path FROM a4""")
def path_override(spark, d):
    orders = A.a4_datasets(spark, d)
    other = F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("/archive"), "path"))
    return cat.override_path(orders.select(*KEYS, "path", other.alias("override_path")))


PATTERN = "{}://{}.{}/{lang}/{page}{}"
PATTERN_RE = r"^[^/]*?://[^/]*?\.[^/]*?/([\p{L}\p{N}]+)/([\p{L}\p{N}]+)[^/]*?$"
PATHS_SQL = f"""pk AS (SELECT regexp_extract(url, '{PATTERN_RE}', 1) AS lang, regexp_extract(url, '{PATTERN_RE}', 2) AS page,
  url AS path FROM pages WHERE regexp_matches(url, '{PATTERN_RE}'))"""


@query("path_keys", f"WITH {PATHS_SQL} SELECT lang, page, path FROM pk")
def path_keys(spark, d):
    return P.keys_from_paths(A.a6_paths(spark, d), PATTERN)


@query("path_duplicates", f"""WITH {PATHS_SQL}
SELECT lang, page, CAST(count(*) AS BIGINT) AS n_paths FROM pk GROUP BY 1, 2 HAVING count(*) > 1""")
def path_duplicates(spark, d):
    return P.duplicate_keys(P.keys_from_paths(A.a6_paths(spark, d), PATTERN), ["lang", "page"])


@query("dedup_inputs", """SELECT DISTINCT 'http' || substr(url, position('://' IN url)) AS path FROM pages""")
def dedup_inputs(spark, d):
    return P.dedup_inputs(A.a6_paths(spark, d).withColumn("path", F.regexp_replace("path", "^https", "http")))


@query("pending_inputs", """
WITH ins AS (SELECT '/in/' || CAST(o_orderkey AS VARCHAR) || '.raw.img' AS path, o_orderkey, o_orderstatus FROM orders)
SELECT path FROM ins WHERE o_orderstatus <> 'F'""")
def pending_inputs(spark, d):
    o = A.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    ins = o.select(F.concat(F.lit("/in/"), key, F.lit(".raw.img")).alias("path"))
    outs = o.where("o_orderstatus = 'F'").select(F.concat(key, F.lit(".raw.tif")).alias("path"))
    return P.pending_inputs(ins, outs)


@query("catalog_upgrade", f"""WITH {A.A4_SQL}
SELECT status, priority, customer, path, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS west,
       CAST(CAST(o_totalprice * 2 AS FLOAT) AS DOUBLE) AS mean FROM a4""")
def catalog_upgrade(spark, d):
    orders = A.a4_datasets(spark, d)
    old = orders.select(*KEYS, F.col("path").alias("filepath"), F.col("o_totalprice").cast("float").alias("bounds_north"),
                        (F.col("o_totalprice") * 2).cast("float").alias("mean"))
    return cat.rename_bounds(cat.upgrade_metadata_0_8(cat.upgrade_datasets_0_7(old)))


# --- the catalog as a log -------------------------------------------------------

_UNIQUE_SQL = f"""{A.A4_SQL}, u AS (
  SELECT status, priority, customer, max_by(path, o_orderkey) AS path, round(avg(o_totalprice), 4) AS mean, max(o_orderkey) AS k FROM a4 GROUP BY 1, 2, 3)"""
_CURSOR = ("F", "3-MEDIUM", "5")


def _logged(spark, d):
    """Datasets with statistics, then changed ones without, then deletions, in commits of their own."""
    keys = A.A4_KEYS
    unique = A.a4_datasets(spark, d).groupBy(*keys).agg(
        F.max_by("path", "o_orderkey").alias("path"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_orderkey").alias("k"))
    log = CatalogLog.create(spark, new_folder(spark, "catalog-log"), keys, file_rows=500)
    log.upsert(unique.select(*keys, "path"), unique.select(*keys, "mean"))
    log.compact()
    changed = unique.where("k % 3 = 0")
    log.upsert(changed.select(*keys, F.concat(F.lit("/new"), "path").alias("path")))
    log.add_metadata(changed.where("k % 2 = 0").select(*keys, (-F.col("mean")).alias("mean")))
    log.delete(unique.where("k % 5 = 1").select(*keys))
    return log


_LOGGED_SQL = f"""{_UNIQUE_SQL}, l AS (
  SELECT status, priority, customer, CASE WHEN k % 3 = 0 THEN '/new' || path ELSE path END AS path,
    CASE WHEN k % 3 <> 0 THEN mean WHEN k % 2 = 0 THEN -mean END AS mean FROM u WHERE k % 5 <> 1)"""


@query("catalog_log", f"WITH {_LOGGED_SQL} SELECT * FROM l")
def catalog_log(spark, d):
    catalog = _logged(spark, d).load()
    return catalog.datasets.join(catalog.metadata.select(*A.A4_KEYS, "mean"), A.A4_KEYS, "left")


@query("catalog_page_after", f"""WITH {_LOGGED_SQL}
SELECT status, priority, customer, path FROM l WHERE (status, priority, customer) > {_CURSOR} ORDER BY status, priority, customer LIMIT 200""")
def catalog_page_after(spark, d):
    """The page behind a key, from the files of its key range and the changes since."""
    return _logged(spark, d).page_after(_CURSOR, 200)


@query("key_numbering", """SELECT n_name AS key_name, 'of region ' || CAST(n_regionkey AS VARCHAR) AS description, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS idx FROM nation""")
def key_numbering(spark, d):
    """Keys of an old catalog, which had no positions, numbered by another column."""
    old = A.table(spark, d, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("of region "), F.col("n_regionkey").cast("string")).alias("description"), "n_nationkey")
    return cat.upgrade_keys_0_7(old, order="n_nationkey")
