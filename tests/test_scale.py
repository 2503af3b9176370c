"""Steps whose cost on the driver, or whose input, once depended on the number of files or on overlaps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rastertable.operators import states as S
from rastertable.sources.catalog_log import CatalogLog
from rastertable.sources.cells import pack_blocks, unpack_blocks


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k % 17).cast("float") for k in (1, 3, 5)]).alias("embedding"))
    for name, files in (("many", 3), ("one", 1)):
        rows.repartition(files).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    part = next((tmp_path / "one" / "embeddings.parquet").glob("part-*"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "embeddings.parquet").write_bytes(part.read_bytes())
    want = {r.scene: (r.n, r.m) for r in rows.select(F.concat(F.lit("s"), F.col("vec_id") % 8).alias("scene"), F.explode("embedding").alias("v"))
            .groupBy("scene").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("m")).collect()}
    for name in ("many", "file"):
        got = {r.scene: (r.n_valid, r["mean"]) for r in entry.queries()["ingest_stream"](spark, str(tmp_path / name)).collect()}
        assert got == want


def test_compaction_writes_many_files_in_few_tasks(spark, tmp_path):
    """Every task, and every range it samples, sends something to the driver: files do not need tasks of their own."""
    log = CatalogLog.create(spark, str(tmp_path / "c"), ["sensor", "date"], file_rows=10)
    rows = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("sensor"), F.format_string("%05d", "id").alias("date"), F.lit("p").alias("path"))
    log.upsert(rows)
    log.compact()
    base = log.record()["base"]
    files = [p.name for p in __import__("pathlib").Path(base, "datasets").glob("part-*.parquet")]
    assert len(files) >= 200 and len({f.split("-")[1] for f in files}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = spark.read.parquet(f"{base}/index").orderBy("low").collect()
    assert len(index) == len(files) and sum(r.n for r in index) == 2000 and max(r.n for r in index) <= 10
    assert all(a.high < b.low for a, b in zip(index, index[1:]))


def test_blocks_are_laid_out_many_at_a_time(spark):
    """No Python call per block; groups that reach over Arrow batches, and null keys, stay whole."""
    cells = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("key"), (F.col("id") / 50).cast("int").alias("row"),
                                     (F.col("id") % 50).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = pack_blocks(cells, ["key"], 8)
        assert "FlatMapGroupsInArrow" not in blocks._jdf.queryExecution().toString()
        assert blocks.count() == blocks.select("key", "block_row", "block_col").distinct().count()
        got = {(r.key, r.row, r.col, r.value) for r in unpack_blocks(blocks, ["key"], 8).where("value IS NOT NULL").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {tuple(r) for r in cells.collect()}


def test_scan_sends_a_value_once(spark):
    """Brackets overlap when digests are small; a value goes out once, not once per bracket."""
    cells = spark.range(64 * 64).select(F.lit("k").alias("key"), (F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"),
                                        (F.col("id") * 7919 % 4099).cast("double").alias("value"))
    grids = spark.sql("SELECT 'k' AS key, 64 AS width, 64 AS height")
    blocks = pack_blocks(cells, ["key"], 64)
    merged = S.checkpointed(S.merged_states(S.states_of_blocks(blocks, grids, ["key"], 64, 20), ["key"], 20))
    brackets = S.checkpointed(S._brackets(merged, ["key"]))
    scanned = S._scan(S.with_masks(blocks, grids, ["key"]), brackets, ["key"])
    assert scanned.count() <= 64 * 64 + 99
    got = S.exact_percentiles_of_blocks(blocks, grids, ["key"], merged, node=10).first().percentiles
    assert got == pytest.approx(np.percentile([i * 7919 % 4099 for i in range(4096)], range(1, 100)).tolist())
