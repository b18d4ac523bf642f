"""Scripts and their companion tables, derived by Spark from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing
from .shared import new_folder

CAST = {"characters": {"assistant": "a.wav", "旁白": "n.wav"}, "default_audio": {"male": "m.wav", "female": "f.wav"}}
GENDERS = [("assistant", "male", 0.95), ("user", "female", 0.7)]
KEYWORDS = ["the", "there", "ent"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, line_no, line): conversations rewritten in the notation of scripts."""
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    m = F.col("pos") % 5
    line = (
        F.when(F.col("turn").isin(0, 4) & (F.col("pos") == 0), F.concat(F.lit("Chapter "), F.when(F.col("turn") == 0, "1").otherwise("2"), F.lit(": "), "raw"))
        .when(m == 0, F.concat(F.lit("「"), "raw", F.lit("」")))
        .when(m == 1, F.concat(F.lit("「"), "raw", F.lit("」——"), "role"))
        .when(m == 2, F.concat("role", F.lit("：「"), "raw", F.lit("」")))
        .when(m == 3, F.concat(F.lit("x「"), "raw", F.lit("」y「"), "role", F.lit("」")))
        .when(F.col("turn") % 4 == 3, "  ")
        .when(F.col("turn") % 4 == 1, F.substring("raw", 1, 4))
        .otherwise(F.col("raw"))
    )
    order = Window.partitionBy("book_id").orderBy("turn", "pos")
    return raw.select("book_id", F.row_number().over(order).cast("long").alias("line_no"), line.alias("line"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, ord, label): ten labels of each book."""
    books = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id")).distinct()
    names = F.array(*map(F.lit, ["user", "assistant", T.NARRATOR, T.NON_PERSON, "guest"]))
    rows = books.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return rows.withColumn("label", F.element_at(names, (F.col("ord") % 5 + 1).cast("int")))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fill_chapter(parsing.classify_lines(lines(spark, sf_dir)))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.dialogue_table(lines(spark, sf_dir), labels(spark, sf_dir))


def written_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogues, parsed once and written, for queries that derive several tables from them."""
    path = new_folder(spark, "dialogues")
    dialogues(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def genders(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(GENDERS, "speaker string, gender string, confidence double"))  # a fixed list


def emotions(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(book_id, ord, emotion, tone, confidence, evidence) of three dialogues in four."""
    d = (dialogues(spark, sf_dir) if of is None else of).where("ord % 4 <> 3")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col("ord") % k + 1).cast("int"))
    evidence = F.when(F.col("ord") % 6 == 5, "Error: none").otherwise(F.concat(F.lit("line "), "line_no"))
    return d.select("book_id", "ord", pick(T.EMOTIONS, 7).alias("emotion"), pick(T.TONES, 5).alias("tone"), F.lit(0.5).alias("confidence"), evidence.alias("evidence"))


def files(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(book_id, ord, path, length, modified_s) of every third dialogue; some are empty."""
    d = (dialogues(spark, sf_dir) if of is None else of).where("ord % 3 = 0")
    size = F.when(F.col("ord") % 9 == 0, 0).otherwise(F.col("ord") + 1000).cast("long")
    return d.select("book_id", "ord", T.segment_path(F.col("ord")).alias("path"), size.alias("length"), (F.col("ord") * 7 + F.col("ord") % 5 * 40 + 1_700_000_000).alias("modified_s"))


def segments(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    d = dialogues(spark, sf_dir) if of is None else of
    return d.select("book_id", "ord", "line_no", "chapter", "speaker", (60 * F.length("text")).cast("long").alias("duration_ms"))


def run_log(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    engine = F.when(F.col("ord") % 2 == 0, "clone").otherwise("preset")
    status = F.when(F.col("ord") % 6 == 5, "error").otherwise("ok")
    return (dialogues(spark, sf_dir) if of is None else of).select("book_id", "ord", engine.alias("engine"), ((F.col("ord") % 7 + 1) * 0.5).alias("seconds"), status.alias("status"))


def results(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return run_log(spark, sf_dir, of).where("ord % 4 <> 3").select("book_id", "ord", "status")


def clones(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([("assistant", "a.wav"), ("user", "gone.wav")], "speaker string, ref_audio string"))  # a fixed list


def audio_files(spark: SparkSession) -> DataFrame:
    """(path): reference audio that exists."""
    return F.broadcast(spark.createDataFrame([("a.wav",), ("b.wav",)], "path string"))  # a fixed list


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, frame_idx, rms): the events of a user as a series."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value").alias("rms"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("book_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
