"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

A table written there survives the loss of executors and cuts the lineage of iterative
jobs.  Sessions without the setting (local tests) get a folder of their own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows of a (key, few numbers) table that may be broadcast; beyond it joins are shuffled.
BROADCAST_ROWS = 1_000_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; in a local session without one, a folder of our own."""
    global _own_dir
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the join strategy that its counted rows allow."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with little memory for each Python worker.

    A session that leaves Spark's default number of rows for an Arrow batch gets
    ``BATCH_ROWS``, as whole texts are wide rows; and at the end of a task the worker gives
    free memory back, as Spark keeps workers for later tasks.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, BATCH_ROWS)

    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not all C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(released, schema)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)
