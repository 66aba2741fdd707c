"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


TEXT_ROWS = "2000"  # of an Arrow batch: 10,000 texts are 25 MB and more, several times over in a worker and the JVM


def small_batches(spark: SparkSession) -> None:
    """Arrow batches fit for texts, unless the session sets their rows itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``; only a local session
    without one, as in tests, gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by reliable files in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys, parts: int | None = None) -> DataFrame:
    """Hash-partitioned by ``keys`` over the session's number of shuffle partitions, so that small rows
    which stand for much Python work are not coalesced into few tasks."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def trimmed(f):
    """A function of Arrow batches or of one table that gives its memory back at its end."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            yield from f(batches)
            release()

        return run

    @functools.wraps(f)
    def one(table):
        out = f(table)
        if table.nbytes > 1 << 22:
            release()
        return out

    return one
