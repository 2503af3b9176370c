"""Small helpers that the operators share: inputs, Arrow batches, checkpoints, salts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.sources.shared import checkpointed, new_folder, shared_dir

__all__ = ["checkpointed", "documents", "free_name", "join_small", "map_rows", "new_folder", "read_table", "release", "release_shuffles", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, whatever else the table holds; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, slice_chars: int = 4 << 20) -> DataFrame:
    """Apply ``fn`` to Arrow batches of rows.

    ``fn`` gets a batch and returns its columns by name. Batches are cut to about ``slice_chars``
    bytes, one row at least, so a batch of long texts needs no more memory than one of short texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_chars):
                columns = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)
            columns = part = batch = None
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back; Python workers stay, with what they hold, for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that nothing refers to any more; it learns of them only when the driver collects garbage.

    What Python lets go of reaches the driver's JVM through a queue that is read once a second, and a first collection there leaves some of it."""
    gc.collect()
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while queue and time.monotonic() < until:
        time.sleep(0.05)
    for _ in range(2):
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    start = 0
    while start < batch.num_rows:
        rows = max(1, batch.num_rows - start)
        part = batch.slice(start, rows)
        while rows > 1 and part.get_total_buffer_size() > most and part.nbytes > most:
            rows = max(1, int(rows * min(0.75, most / part.nbytes)))
            part = batch.slice(start, rows)
        yield part
        start += rows


def join_small(big: DataFrame, small: DataFrame, keys: list[str], bound: int = 50_000, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join (inner or left) on ``keys``, of which one may hold a large part of ``big``.

    ``small`` has few rows per key and is counted: up to ``bound`` rows it is broadcast, else each of its rows is
    repeated under every salt and a key's rows of ``big`` are spread over the salts.
    """
    if small.count() <= bound:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("salt_", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return salted.join(small.withColumn("salt_", F.explode(F.array(*map(F.lit, range(salts))))), [*keys, "salt_"], how).drop("salt_")
