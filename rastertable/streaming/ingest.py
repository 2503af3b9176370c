"""Incremental ingest: cells arrive as files, statistics stay up to date.

Each micro-batch is reduced to block states (count, min, max, mean, squared
deviations, and a quantile sketch). A batch writes its states under its own
number and overwrites them when it is run again, so a restart after a lost
executor or driver counts nothing twice. Reading merges all states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastertable.operators.catalog import only_new
from rastertable.operators.percentiles import PERCENTS
from rastertable.operators.stats import block_states, merge_states


def start_ingest(cells: DataFrame, keys, root: str, block_size: int = 256, available_now: bool = True) -> StreamingQuery:
    """Start reducing a stream of cells (keys, row, col, value) into states under ``root``.

    With ``available_now`` the query ends when the files that exist now are
    done. States are read back added up, for pixels that arrive once, or only
    the newest of each block, for blocks that arrive whole and may come again; one that is wholly masked then replaces what was there.
    """
    keys = list(keys)

    def reduce_batch(batch: DataFrame, number: int) -> None:
        block_states(batch, keys, block_size, sketch=True, masked=True).write.parquet(
            f"{root}/states/batch={number}", mode="overwrite")

    writer = cells.writeStream.foreachBatch(reduce_batch).option("checkpointLocation", f"{root}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_states(spark: SparkSession, root: str, keys, newest: bool = False) -> DataFrame:
    """All block states, or with ``newest`` the state of each block's last batch."""
    states = spark.read.parquet(f"{root}/states")
    if not newest:
        return states.drop("batch")
    block = [*keys, "block_row", "block_col"]
    rest = [c for c in states.columns if c not in (*block, "batch")]
    return states.groupBy(*block).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*block, "_last.*")


def streamed_stats(spark: SparkSession, root: str, keys, newest: bool = False) -> DataFrame:
    """Statistics of everything seen so far: n_valid, min, max, mean, stdev."""
    return merge_states(read_states(spark, root, keys, newest), keys)


def streamed_percentiles(spark: SparkSession, root: str, keys, newest: bool = False) -> DataFrame:
    """Approximate percentiles 1..99 of everything seen so far, from the merged sketches."""
    ranks = F.array(*[F.lit(p / 100.0) for p in PERCENTS])
    merged = read_states(spark, root, keys, newest).where("n > 0").groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_sketch"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("_sketch", ranks).alias("percentiles"))


def new_datasets(spark: SparkSession, root: str, keys, existing: DataFrame) -> DataFrame:
    """Keys that have arrived and are not in the catalog yet."""
    return only_new(read_states(spark, root, keys).where("n > 0").select(*keys).distinct(), existing, list(keys))
