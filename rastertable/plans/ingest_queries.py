"""Whole-collection ingest and its streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertable.operators import ingest as I
from rastertable.operators.catalog import Catalog
from rastertable.plans import adapters as A
from rastertable.plans.geo_queries import bounds_sql
from rastertable.plans.registry import query
from rastertable.plans.stats_queries import SQL_MOMENTS, r
from rastertable.sources.catalog_log import CatalogLog
from rastertable.sources.cells import pack_blocks
from rastertable.sources.shared import new_folder
from rastertable.streaming.catalog import start_catalog_ingest
from rastertable.streaming.ingest import start_ingest, streamed_stats

PATTERN = "/rasters/{area}/{scene}_{}.tif"


def _path():
    return F.concat(F.lit("/rasters/europe/"), "scene", F.lit("_v1.tif"))


@query("ingest_batch", f"""WITH {A.A1_SQL}, {bounds_sql('EPSG:4326')}
SELECT 'europe' AS area, s.scene, '/rasters/europe/' || s.scene || '_v1.tif' AS path, min, max, mean, stdev,
  round(n_valid / CAST(width * height AS DOUBLE) * 100, 6) AS valid_percentage, round(CAST(p50 AS DOUBLE), 5) AS p50,
  round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north
FROM (SELECT scene, {SQL_MOMENTS}, CAST(quantile_cont(v, 0.5) AS FLOAT) AS p50 FROM (SELECT scene, value AS v FROM a1) GROUP BY 1) s
JOIN bounds USING (scene)""")
def ingest_batch(spark, d):
    """Paths give the keys, rasters known by path give the statistics, all in one job."""
    grids = A.a1_grids(spark, d, "EPSG:4326").withColumn("path", _path()).drop("scene")
    cells = A.a1_cells(spark, d).withColumn("path", _path()).drop("scene")
    datasets = I.datasets_from_paths(grids.select("path"), PATTERN)
    catalog = I.ingest(Catalog.create(spark, ["area", "scene"]), datasets, cells, grids)
    out = catalog.datasets.join(catalog.metadata, ["area", "scene"])
    rounded = [r(c).alias(c) for c in ("min", "max", "mean", "stdev", "valid_percentage", "west", "south", "east", "north")]
    return out.select("area", "scene", "path", *rounded,
                      F.round(F.get("percentiles", F.lit(49)).cast("double"), 5).alias("p50"))


_MASKED = 'CASE WHEN "row" + col >= 12 AND col % 5 <> 2 THEN value END'


@query("ingest_blocks", f"""WITH {A.A1_SQL}, {bounds_sql('EPSG:4326')}, ps AS (SELECT unnest(range(1, 100)) AS p)
SELECT 'europe' AS area, s.scene, '/rasters/europe/' || s.scene || '_v1.tif' AS path, min, max, mean, stdev,
  round(n_valid / CAST(width * height AS DOUBLE) * 100, 6) AS valid_percentage,
  round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north,
  CAST(p AS INTEGER) AS p, round(CAST(CAST(q[p] AS FLOAT) AS DOUBLE), 5) AS value, '{{"sensor":"' || s.scene || '"}}' AS metadata
FROM (SELECT scene, {SQL_MOMENTS}, quantile_cont(v, [{', '.join(f'{p / 100}' for p in range(1, 100))}]) AS q
      FROM (SELECT scene, {_MASKED} AS v FROM a1) GROUP BY 1) s
JOIN bounds USING (scene), ps""")
def ingest_blocks(spark, d):
    """Whole metadata rows from stored blocks with nodata and alpha: one scan for states, one more for percentiles."""
    grids = A.a1_grids(spark, d, "EPSG:4326").withColumns({"path": _path(), "nodata": F.lit(-99.0), "has_alpha": F.lit(True)}).drop("scene")
    cells = (A.a1_cells(spark, d).withColumn("path", _path()).drop("scene")
             .withColumn("value", F.when(F.col("row") + F.col("col") < 12, F.lit(-99.0)).otherwise(F.col("value"))))
    blocks = pack_blocks(cells, ["path"], 32).withColumn("alpha", F.transform("values", lambda v, i: F.when((F.col("block_col") * 32 + i % 32) % 5 == 2, 0).otherwise(255)))
    datasets = I.datasets_from_paths(grids.select("path"), PATTERN)
    extra = datasets.select("area", "scene", F.to_json(F.struct(F.col("scene").alias("sensor"))).alias("metadata"))
    catalog = I.ingest(Catalog.create(spark, ["area", "scene"]), datasets, blocks=blocks, grids=grids, extra=extra, size=32, digest=200)
    out = catalog.datasets.join(catalog.metadata, ["area", "scene"])
    rounded = [r(c).alias(c) for c in ("min", "max", "mean", "stdev", "valid_percentage", "west", "south", "east", "north")]
    return out.select("area", "scene", "path", *rounded, "metadata", F.posexplode("percentiles").alias("i", "q")).select(
        "*", (F.col("i") + 1).alias("p"), F.round(F.col("q").cast("double"), 5).alias("value")).drop("i", "q")


@query("ingest_stream", f"""WITH {A.A1_SQL}
SELECT scene, {SQL_MOMENTS} FROM (SELECT scene, value AS v FROM a1) GROUP BY 1""")
def ingest_stream(spark, d):
    """The same statistics from a stream of files, reduced batch by batch."""
    schema = A.table(spark, d, "embeddings").schema
    # as a pattern, the table may be one file or a folder of files; a stream refuses the plain path of a file
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{{embeddings.parquet}}")
    root = new_folder(spark, "ingest-stream")
    start_ingest(A.embedding_pixels(files), A.A1_KEYS, root, 16).awaitTermination()
    out = streamed_stats(spark, root, A.A1_KEYS)
    return out.select("scene", F.col("n_valid").cast("long").alias("n_valid"), *[r(c).alias(c) for c in ("min", "max", "mean", "stdev")])


@query("ingest_stream_again", f"""WITH {A.A1_SQL}
SELECT scene, {SQL_MOMENTS} FROM (SELECT scene, value AS v FROM a1) GROUP BY 1""")
def ingest_stream_again(spark, d):
    """Files of whole scenes in several micro-batches; one scene comes with wrong values first and replaces them later."""
    cells, source, root = A.a1_cells(spark, d), new_folder(spark, "cells"), new_folder(spark, "ingest-stream")
    wrong = cells.withColumn("value", F.when(F.col("scene") == "s3", F.col("value") * 2 + 1).otherwise(F.col("value")))

    def stream():
        files = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(source)
        start_ingest(files, A.A1_KEYS, root, 16).awaitTermination()

    wrong.repartitionByRange(4, "scene").write.parquet(source)
    stream()
    cells.where("scene = 's3'").coalesce(1).write.parquet(source, mode="append")
    stream()
    out = streamed_stats(spark, root, A.A1_KEYS, newest=True)
    return out.select("scene", F.col("n_valid").cast("long").alias("n_valid"), *[r(c).alias(c) for c in ("min", "max", "mean", "stdev")])


@query("ingest_stream_catalog", f"""WITH {A.A1_SQL}, {A.a1_grids_sql('EPSG:4326')}
SELECT scene, '/rasters/europe/' || scene || '_v1.tif' AS path, n_valid, min, max, mean, stdev, round(n_valid / CAST(width * height AS DOUBLE) * 100, 6) AS valid_percentage
FROM (SELECT scene, {SQL_MOMENTS} FROM (SELECT scene, value * CASE WHEN scene = 's2' THEN 3 ELSE 1 END AS v FROM a1
      WHERE NOT (scene = 's3' AND "row" < 16 AND col BETWEEN 16 AND 31) AND scene <> 's5') GROUP BY 1) JOIN g1 USING (scene)""")
def ingest_stream_catalog(spark, d):
    """Three micro-batches into the catalog log: all blocks; then one block and one dataset that are masked now, and one dataset changed; then the second batch repeated."""
    grids = A.a1_grids(spark, d, "EPSG:4326").withColumn("path", _path())
    blocks, source, root = pack_blocks(A.a1_cells(spark, d), A.A1_KEYS, 16), new_folder(spark, "blocks"), new_folder(spark, "stream")
    log = CatalogLog.create(spark, new_folder(spark, "catalog"), A.A1_KEYS)
    masked = F.transform("values", lambda v: F.lit(float("nan")))
    some = blocks.where("scene IN ('s2', 's5') OR (scene = 's3' AND block_row = 0 AND block_col = 1)").withColumn(
        "values", F.when(F.col("scene") == "s2", F.transform("values", lambda v: v * 3)).otherwise(masked))
    for batch in (blocks, some, some):
        batch.coalesce(1).write.parquet(source, mode="append")
        files = spark.readStream.schema(blocks.schema).parquet(source)
        start_catalog_ingest(files, grids, A.A1_KEYS, log, root, 16).awaitTermination()
    catalog = log.load()
    out = catalog.datasets.join(catalog.metadata, A.A1_KEYS)
    count = A.a1_grids(spark, d).select("scene", (F.col("width").cast("long") * F.col("height")).alias("total"))
    n = F.rint(F.col("valid_percentage") * F.col("total") / 100).cast("long").alias("n_valid")
    return out.join(count, "scene").select("scene", "path", n, *[r(c).alias(c) for c in ("min", "max", "mean", "stdev", "valid_percentage")])
