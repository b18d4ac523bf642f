"""Segments, splice timelines and chapter manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import RANGE, scan


def all_segments(dialogues: DataFrame, files: DataFrame) -> DataFrame:
    """One segment for each dialogue, and whether its file is there and not empty."""
    f = files.where("length > 0").select("book_id", "ord", F.lit(True).alias("_f"))
    out = dialogues.join(f.hint("merge"), ["book_id", "ord"], "left")
    return out.select("book_id", "ord", "chapter", "speaker", T.segment_path(F.col("ord")).alias("audio_path"), F.coalesce("_f", F.lit(False)).alias("readable"))


def order_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumn("ord", F.coalesce("ord", F.lit(0).cast("long"))).orderBy("book_id", "ord", "line_no")


def order_files(files: DataFrame) -> DataFrame:
    """Files (book_id, path) by the number that their name starts with."""
    stem = F.regexp_extract("path", r"(\d+)[^/]*\.wav$", 1).try_cast("long")
    return files.withColumn("stem", stem).orderBy("book_id", "stem")


def splice_timeline(segments: DataFrame, gap_dialogue: int = 300, gap_paragraph: int = 1000, gap_chapter: int = 2000, paragraph: str | None = None, width: int = RANGE) -> DataFrame:
    """gap_ms, start_ms and end_ms of each segment, in milliseconds from the start of its book."""
    near = {"_chapter": F.col("chapter")} | ({"_paragraph": F.col(paragraph)} if paragraph else {})
    rows = scan(segments, "book_id", ["ord"], before=near, width=width)
    gap = F.when(F.col("_chapter").isNull(), 0).when(F.col("_chapter") != F.col("chapter"), gap_chapter)
    if paragraph:
        gap = gap.when(F.col("_paragraph") != F.col(paragraph), gap_paragraph)
    rows = rows.withColumn("gap_ms", gap.otherwise(gap_dialogue).cast("long")).drop("_chapter", "_paragraph")
    out = scan(rows, "book_id", ["ord"], sums={"end_ms": F.col("gap_ms") + F.col("duration_ms")}, width=width)
    return out.withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def fade_plan(segments: DataFrame, fade: int = 50) -> DataFrame:
    """No fade in segments too short for two of them."""
    return segments.withColumn("fade_ms", F.when(F.col("duration_ms") >= 2 * fade, fade).otherwise(0).cast("long"))


def chapter_manifest(segments: DataFrame) -> DataFrame:
    """(book_id, file_index, title, segments, duration_ms): chapters as they first appear."""
    c = segments.groupBy("book_id", "chapter").agg(F.min("ord").alias("_first"), F.count("*").alias("segments"), F.sum("duration_ms").alias("duration_ms"))
    i = F.row_number().over(Window.partitionBy("book_id").orderBy("_first")).cast("long")
    c = c.withColumn("file_index", i)
    title = F.when(F.col("chapter") == "", F.format_string("chapter_%d", "file_index")).otherwise(F.col("chapter"))
    return c.select("book_id", "file_index", title.alias("title"), "segments", "duration_ms")


def volume_stats(files: DataFrame, timeline: DataFrame) -> DataFrame:
    """(book_id, size_mb, duration_ms)."""
    size = files.groupBy("book_id").agg(F.round(F.sum("length") / 2**20, 4).alias("size_mb"))
    return timeline.groupBy("book_id").agg(F.max("end_ms").alias("duration_ms")).join(size.hint("merge"), "book_id", "left")
