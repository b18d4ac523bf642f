"""Listings of a live folder in rounds: each stores and returns only what is new, changed or gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scripts import scan_segment_files
from .voices import version_numbers

SCHEMA = "path string, ord long, length long, modified timestamp, gone boolean"


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """(path, ord, length, modified) of the files that were there at the last whole round; none before the first."""
    rounds = version_numbers(spark, manifest, True)
    if not rounds:
        return spark.createDataFrame([], SCHEMA).drop("gone")
    # rounds that are whole are named, so that one that failed half way, or runs now, isn't read
    folders = [f"{manifest}/version={n:010d}" for n in rounds]
    seen = spark.read.schema(SCHEMA + ", version long").option("basePath", manifest).parquet(*folders)
    last = seen.groupBy("path").agg(F.max_by(F.struct("ord", "length", "modified", "gone"), "version").alias("f"))
    return last.select("path", "f.*").where(~F.col("gone")).drop("gone")


def list_changes(spark: SparkSession, path: str, manifest: str, number: str = r"/(\d+)[^/]*\.wav$") -> DataFrame:
    """(path, ord, length, modified, gone) of the audio files below ``path`` that differ from the last round.

    A file is new or changed if its path, length or time differs, and ``gone`` if it was deleted or emptied.  The
    file system is still asked for all names; contents aren't read, and only differences are
    stored and returned.  A round counts once all of it is written; one that fails is made up for by
    the next.  Two rounds at once can't both succeed with one number.
    """
    now = scan_segment_files(spark, path, number)
    then = read_manifest(spark, manifest)
    both = now.alias("n").hint("merge").join(then.alias("t"), "path", "full_outer")
    gone = F.col("n.modified").isNull()
    differs = gone | ~(F.col("n.length").eqNullSafe(F.col("t.length")) & F.col("n.modified").eqNullSafe(F.col("t.modified")))
    kept = [F.when(gone, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("ord", "length", "modified")]
    changes = both.where(differs).select("path", *kept, gone.alias("gone"))
    n = max(version_numbers(spark, manifest, False), default=0) + 1
    out = f"{manifest}/version={n:010d}"
    changes.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(out)
    return spark.read.schema(SCHEMA).parquet(out)

