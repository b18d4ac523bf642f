"""Numbered lines of text files of any size.

A file is read in splits, in parallel; a first pass counts the lines of each split, a small table
of one row a split turns the counts into the number that each split begins with, and a second pass
numbers the lines where they are read, without a shuffle.  No task reads a whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import new_folder

#: Splits whose table may be broadcast (some 100 bytes each); beyond it, it is joined by a shuffle.
BROADCAST_SPLITS = 100_000
PLACE = ["book_id", "file", "split"]
#: A return at the very end; ``$`` would also find one before another line end.
RETURN = r"\r\z"
BOM = "﻿"


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(book_id, line_no, line) from whole texts (book_id, value) that fit into a cell."""
    at = texts.select("book_id", F.posexplode(T.split_lines(F.col("value"))).alias("pos", "line"))
    return at.select("book_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, file, split, size, at, value): what stands between line feeds, with its split and place in it."""
    raw = spark.read.schema("value string, book_id long").option("lineSep", "\n").text(path)
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "split"), ("file_size", "size"))]
    return raw.select("book_id", *meta, F.monotonically_increasing_id().alias("at"), "value")


def _parts(ended: Column) -> Column:
    """The lines in a record: it may hold line ends beside the line feed that ``ended`` it, or be the unfinished rest of a file."""
    whole = F.split(F.regexp_replace("value", RETURN, ""), T.LINE_END)  # with a line feed behind it, a return is part of the line end
    return F.when(ended, whole).otherwise(T.split_lines(F.col("value")))


def split_table(records: DataFrame) -> DataFrame:
    """One row for each split: its first record, the lines before it in its book, and how the book's file ends.

    The files of a book follow each other by path.
    """
    n = F.size(_parts(F.lit(True)))
    last = F.max(F.struct("at", F.size(_parts(F.lit(False))).alias("open"), n.alias("ended")))
    counts = records.groupBy(*PLACE, "size").agg(F.count("*").alias("records"), F.sum(n).alias("lines"), F.min("at").alias("first_at"), last.alias("last"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    file = Window.partitionBy("book_id", "file")
    counts = counts.withColumn("file_bytes", F.sum("bytes").over(file)).withColumn("is_last", F.col("split") == F.max("split").over(file))
    # a file without a line feed at its end is a byte shorter than its records with theirs; a mark of byte order isn't in the records
    missing = F.col("file_bytes") - F.col("size")
    open_end = missing.isin(1, -2) & F.col("is_last")
    counts = counts.withColumn("open_at", F.when(open_end, F.col("last.at"))).withColumn("marked", missing.isin(-2, -3))
    counts = counts.withColumn("lines", F.col("lines") - F.when(open_end, F.col("last.ended") - F.col("last.open")).otherwise(0))
    before = F.sum("lines").over(Window.partitionBy("book_id").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("split").over(file) == F.col("split")
    marked = F.when(F.col("marked") & first, F.col("first_at"))
    return counts.select(*PLACE, "first_at", "records", "lines", F.coalesce(before, F.lit(0)).alias("before"), "open_at", marked.alias("marked_at"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, line_no, line) of the UTF-8 text files in folders ``book_id=...``.

    Lines end as text editors know them; ``\\r\\n`` is one end, also where a split of the file
    falls between the two.  What stands between two line feeds must fit into a cell.  The splits are
    counted when this is called, once; a later action fails if the files have changed since.
    """
    records = _records(spark, path)
    folder = new_folder(spark, "splits")
    split_table(records).write.parquet(folder)
    table = spark.read.parquet(folder)
    n, odd = table.agg(F.count("*"), F.coalesce(F.count_if((F.col("records") != F.col("lines")) | F.col("open_at").isNotNull()), F.lit(0))).first()
    table = F.broadcast(table) if n <= BROADCAST_SPLITS else table.hint("merge")
    rows = records.drop("size").join(table, PLACE, "left")
    same = F.col("first_at").isNotNull() & (F.col("at") - F.col("first_at") < F.col("records"))
    rows = rows.withColumn("before", F.when(same, F.col("before")).otherwise(F.raise_error(F.lit("the files or their splits have changed since they were counted")).cast("long")))
    if not odd:  # each record is a line
        place = F.col("before") + F.col("at") - F.col("first_at") + 1
        return rows.select("book_id", place.alias("line_no"), _shown(F.regexp_replace("value", RETURN, "")).alias("line"))
    # only splits with other line ends are numbered by a window, each on its own
    plain = F.coalesce((F.col("records") == F.col("lines")) & F.col("open_at").isNull(), F.lit(True))  # rows of no known split stay, to fail
    even = rows.where(plain).select("book_id", (F.col("before") + F.col("at") - F.col("first_at") + 1).alias("line_no"), _shown(F.regexp_replace("value", RETURN, "")).alias("line"))
    parts = rows.where(~plain).withColumn("parts", _parts(F.coalesce(F.col("at") != F.col("open_at"), F.lit(True))))
    upto = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.col("before") + F.coalesce(F.sum(F.size("parts")).over(upto), F.lit(0)))
    parts = parts.select("book_id", "before", "at", "marked_at", F.posexplode("parts").alias("pos", "value"))
    marked = F.when((F.col("at") == F.col("marked_at")) & (F.col("pos") == 0), F.concat(F.lit(BOM), "value")).otherwise(F.col("value"))
    return even.union(parts.select("book_id", (F.col("before") + F.col("pos") + 1).alias("line_no"), marked.alias("line")))


def _shown(value: Column) -> Column:
    """A line, with the mark of byte order that the reader takes off the first of a file."""
    return F.when(F.col("at") == F.col("marked_at"), F.concat(F.lit(BOM), value)).otherwise(value)
