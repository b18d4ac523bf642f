"""Folders that driver and executors share, for tables and files that queries write and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None

#: Files that a task writes, on average.
FILES_PER_TASK = 500


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; in a local session without it, below a temporary folder."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, files: int, root: str, order: list[str] | None = None) -> None:
    """The lines (folder, name, value) as files below ``root``, those of one file in the order of ``order``.

    ``files`` is about how many there are: it sets the number of tasks.  Rows are small, so that Spark
    would put all of them into one task, though each may be a file.  Tasks write through Arrow's file
    systems: Spark's own writer makes a folder for each name, and on a local disk starts a process for each
    file and folder.  A file is streamed; a task that runs again writes the same files again.
    """
    fs, base = FileSystem.from_uri(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, n = None, None, 0
        for batch in batches:
            listed = zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "value")), strict=True)
            for place, lines in groupby(listed, itemgetter(0, 1)):
                if place != at:
                    if out is not None:
                        out.close()
                    if at is None or place[0] != at[0]:
                        fs.create_dir(f"{base}/{place[0]}", recursive=True)
                    at, out, n = place, fs.open_output_stream(f"{base}/{place[0]}/{place[1]}"), n + 1
                out.write(b"".join(line[2] + b"\n" for line in lines))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    order = order or []
    dealt = rows.repartition(max(-(-files // FILES_PER_TASK), 1), "folder", "name").sortWithinPartitions("folder", "name", *order)
    value = F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value")
    dealt.select("folder", "name", value).mapInArrow(write, "n long").agg(F.sum("n")).collect()
