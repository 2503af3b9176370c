"""Blocks arrive as files; the catalog's statistics follow, batch by batch.

A batch reduces its blocks to states (wholly masked blocks too, so that they replace what was there), keeps them under its own number, merges the newest
state of every block of the datasets it touched, and upserts their rows into the catalog log. Both steps can run again: states
are overwritten, and the log knows the last batch of each stream, so a batch that is repeated after a lost driver changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastertable.operators.states import DIGEST, merged_states, metadata_of_states, states_of_blocks
from rastertable.sources.catalog_log import CatalogLog
from rastertable.sources.cells import BLOCK_SIZE
from rastertable.sources.shared import checkpointed


def start_catalog_ingest(blocks: DataFrame, grids: DataFrame, keys, log: CatalogLog, root: str, size: int = BLOCK_SIZE, digest: int = DIGEST,
                         available_now: bool = True) -> StreamingQuery:
    """Start a stream of blocks (keys, block_row, block_col, values, optionally alpha and version) into ``log``.

    ``grids`` holds a header and the ``path`` of every dataset that may come, with its nodata and alpha rules. A block that comes again replaces
    the earlier one; inside a batch the larger ``version`` does. Datasets whose blocks are all masked leave the catalog. Percentiles
    come from digests.
    """
    keys = list(keys)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = F.col("version").cast("long") if "version" in batch.columns else F.lit(0).cast("long")
        block = [*keys, "block_row", "block_col"]
        rest = [c for c in batch.columns if c not in (*block, "version")]
        newest = batch.groupBy(*block).agg(F.max_by(F.struct(*rest), versions).alias("last")).select(*block, "last.*")
        states_of_blocks(newest, grids, keys, size, digest).write.parquet(f"{root}/states/batch={number}", mode="overwrite")
        touched = checkpointed(spark.read.parquet(f"{root}/states/batch={number}").select(*keys).distinct())
        current = current_states(spark, root, keys, number).join(touched, keys, "left_semi")
        metadata = checkpointed(metadata_of_states(checkpointed(current), grids, keys, size, digest))
        paths = grids.join(metadata.select(*keys), keys, "left_semi").select(*keys, "path")
        gone = touched.join(metadata.select(*keys), keys, "left_anti")
        log.apply(paths, metadata, gone, ("ingest:" + root, number))

    writer = blocks.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_states(spark: SparkSession, root: str, keys, upto: int | None = None) -> DataFrame:
    """The state of each block's last batch (of those up to ``upto``), wholly masked blocks included."""
    block = [*keys, "block_row", "block_col"]
    states = spark.read.parquet(f"{root}/states")
    if upto is not None:
        states = states.where(F.col("batch") <= upto)
    rest = [c for c in states.columns if c not in (*block, "batch")]
    return states.groupBy(*block).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*block, "last.*")


def streamed_moments(spark: SparkSession, root: str, keys, digest: int = DIGEST) -> DataFrame:
    from rastertable.operators.states import moments_of

    return moments_of(merged_states(checkpointed(current_states(spark, root, list(keys))), keys, digest), keys)
