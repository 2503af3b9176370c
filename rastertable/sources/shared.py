"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="rastertable-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own under the shared folder; not created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a short file under a name that nobody has used; False if it is there already.

    The file is written aside and renamed, and the rename fails if the name is taken, so of several writers exactly one succeeds.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    spare = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    fs = spare.getFileSystem(conf)
    fs.mkdirs(spare.getParent())
    out = fs.create(spare, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(spare, final, options)
    except Py4JJavaError as exc:
        fs.delete(spare, False)
        if "FileAlreadyExists" in exc.java_exception.getClass().getName():
            return False
        raise
    return True


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute now, keep the rows in the shared folder and cut the lineage."""
    sc = df.sparkSession.sparkContext
    path = shared_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return df.checkpoint(eager=True)
