"""The relational tables of projects, characters, dialogues and audio files, with surrogate keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.casting import surest_gender
from .shared import new_folder

# What the tables allow.
STATUS = ["created", "parsed", "synthesizing", "done"]
AUDIO_SOURCE = ["upload", "preset"]


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... without gaps, in the order of ``order``.

    Rows are sorted into partitions, which are written; each partition counts its own, and the
    counts, one row a partition, say where it begins.  Equal rows each have a number of their own.
    This writes ``df`` when it is called, so that the numbers stay the same whenever they are read.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_at", place)
    folder = new_folder(spark, "numbered")
    sorted_rows.write.parquet(folder)
    rows = spark.read.schema(sorted_rows.schema).parquet(folder)
    parts = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    parts = parts.select("_p", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(parts), "_p")  # as many rows as the sort had partitions
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + start).drop("_p", "_at", "_first", "_before")


def one_of(c: Column, allowed: list[str], what: str) -> Column:
    """``c``, or an error in the job if it is null or none of the allowed values."""
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"no {what}: "), F.coalesce(c, F.lit("null")))))


def relational_tables(dialogues: DataFrame, genders: DataFrame, audio: DataFrame, created_at: datetime, status: str | DataFrame = "parsed") -> dict[str, DataFrame]:
    """projects, characters, dialogues and audio_files.

    ``audio`` (book_id, speaker, file_path, source) has the reference audio of speakers; those that no
    dialogue names are left out.  ``status`` holds for all projects, or is a table (book_id, status).  Ids
    count from 1 in the order of books, of a book's speakers by name, of its dialogues, and of audio files
    by character and path, and every foreign key has its row.  Genders are those of the surest
    verdict, by book where verdicts have one, ``unknown`` without any.
    """
    stamp = F.lit(created_at).cast("timestamp")
    books = dialogues.select("book_id").distinct()
    if isinstance(status, str):
        books = books.withColumn("status", F.lit(status))
    else:
        books = books.join(status.select("book_id", "status").hint("merge"), "book_id", "left")
    projects = dense_ids(books.select("book_id", one_of(F.col("status"), STATUS, "status").alias("status")), ["book_id"])
    of_book = projects.select("book_id", F.col("id").alias("project_id"))

    people = dialogues.where("speaker <> ''").groupBy("book_id", "speaker").agg(F.count("*").alias("dialogue_count"))
    keys, sure = surest_gender(genders)
    people = people.join(sure.hint("merge"), keys, "left").join(of_book.hint("merge"), "book_id")
    people = people.select("book_id", F.col("speaker").alias("name"), F.coalesce("_g", F.lit("unknown")).alias("gender"), "dialogue_count", "project_id")
    characters = dense_ids(people, ["project_id", "name"])

    said = dialogues.join(of_book.hint("merge"), "book_id").select("chapter", "text", "speaker", F.col("ord").alias("order"), "project_id")
    owner = characters.select("book_id", F.col("name").alias("speaker"), F.col("id").alias("character_id"))
    files = audio.join(owner.hint("merge"), ["book_id", "speaker"]).select("file_path", one_of(F.col("source"), AUDIO_SOURCE, "source of audio").alias("source"), "character_id", stamp.alias("created_at"))
    return {
        "projects": projects.select("id", F.concat(F.lit("book "), "book_id").alias("name"), "status", stamp.alias("created_at")),
        "characters": characters.select("id", "name", "gender", "dialogue_count", "project_id"),
        "dialogues": dense_ids(said, ["project_id", "order"]).select("id", "chapter", "text", "speaker", "order", "project_id"),
        "audio_files": dense_ids(files, ["character_id", "file_path"]).select("id", "file_path", "source", "character_id", "created_at"),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, in files as large as their partitions, however many projects there are."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def character_audio(cast: DataFrame) -> DataFrame:
    """(book_id, speaker, file_path, source) of speakers with their reference audio, from rows of ``casting.cast_voice``.

    Audio of a speaker's own (``own_audio``) is an upload, what stands for a gender a preset.
    """
    source = F.when(F.col("own_audio"), "upload").otherwise("preset")
    return cast.where("speaker <> ''").select("book_id", "speaker", F.col("ref_audio").alias("file_path"), source.alias("source")).distinct()
