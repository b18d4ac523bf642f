"""The registry of voices: versions that are switched at once, and list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "voice_id string, voice_name string, ref_audio_path string, metadata map<string,string>"
FIELDS = ["voice_id", "voice_name", "ref_audio_path", "metadata"]


def read_voices(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Voices of JSON files that hold a list each, or, ``per_line``, one voice on each line."""
    return spark.read.schema(SCHEMA).json(path, multiLine=not per_line)


def upsert_voices(voices: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows with all their columns; of one voice_id the row with the largest ``seq`` stays whole."""
    rest = [c for c in voices.columns if c != "voice_id"]
    last = F.max_by(F.struct(*rest), "seq").alias("v")
    return voices.unionByName(new.select(voices.columns)).groupBy("voice_id").agg(last).select("voice_id", "v.*")


def version_numbers(spark: SparkSession, root: str, done: bool) -> list[int]:
    """Numbers of the versions below ``root``, of those that are whole, or of all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*" + ("/_SUCCESS" if done else ""))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [str((f.getPath().getParent() if done else f.getPath()).getName()) for f in found]
    return sorted(int(n.removeprefix("version=")) for n in names)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """The voices of the newest whole version; none if there is no version yet.

    A frame that was read stays on its version while later ones are written.
    """
    versions = version_numbers(spark, root, True)
    if not versions:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{root}/version={versions[-1]:010d}")


def write_registry(voices: DataFrame, root: str) -> int:
    """A new version with these voices; its number.

    Readers see it when Spark has committed all of it and marks it as whole, never before; a write that
    fails leaves the version before as the current one.  Two writers at once can't both succeed
    with one number.
    """
    spark = voices.sparkSession
    number = max(version_numbers(spark, root, False), default=0) + 1
    voices.select(FIELDS).write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").json(f"{root}/version={number:010d}")
    return number


def merge_voices(new: DataFrame, root: str) -> int:
    """The registry with ``new`` (voice_id, voice_name, ref_audio_path, metadata[, seq]) in place of rows of the same id.

    Of several new rows of one id the one with the largest ``seq`` counts.  The number of the version.
    """
    seq = F.coalesce(F.col("seq"), F.lit(0)).cast("long") if "seq" in new.columns else F.lit(0).cast("long")
    fresh = new.select(*FIELDS, seq.alias("seq"))
    # what is stored is older than any new row
    stored = read_registry(new.sparkSession, root).withColumn("seq", F.lit(-(2**63)).cast("long"))
    return write_registry(upsert_voices(stored, fresh), root)


def write_voice_list(voices: DataFrame, path: str) -> None:
    """One JSON file with a list of all voices by id, as ``read_voices`` reads it; rows pass through one task, none is held."""
    order = Window.orderBy("voice_id")
    body = F.to_json(F.struct(*FIELDS))
    rows = voices.select(FIELDS).withColumn("_n", F.row_number().over(order)).withColumn("_more", F.lead("voice_id").over(order).isNotNull())
    start = F.when(F.col("_n") == 1, "[").otherwise("")
    end = F.when(F.col("_more"), ",").otherwise("]")
    rows.select(F.concat(start, body, end).alias("value")).coalesce(1).write.text(path)
