"""Counts, listings and slices of dialogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import AT, RANGE, scan, with_neighbours


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def speaker_counts(dialogues: DataFrame) -> DataFrame:
    """(book_id, speaker, n, first_ord, rank): lines per named speaker, ties by first line."""
    return _ranked(dialogues.where("speaker <> ''"))


def _ranked(dialogues: DataFrame) -> DataFrame:
    c = dialogues.groupBy("book_id", "speaker").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), "first_ord")
    return c.withColumn("rank", F.row_number().over(w).cast("long"))


def top_speakers(dialogues: DataFrame, k: int = 10) -> DataFrame:
    """As ``speaker_counts``, the empty speaker included, the first k of each book."""
    return _ranked(dialogues).where(F.col("rank") <= k)


def kind_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("kind").agg(F.count("*").alias("n"))


def distinct_speakers(dialogues: DataFrame) -> DataFrame:
    return dialogues.where("speaker <> ''").select("book_id", "speaker").distinct()


def slice_dialogues(dialogues: DataFrame, limit: int = 0, between: list[int] | None = None) -> DataFrame:
    """The first ``limit`` rows of each book if it is above 0, else the rows [start, end)."""
    if limit > 0:
        return dialogues.where(F.col("ord") < limit)
    if between is not None and len(between) == 2:
        return dialogues.where((F.col("ord") >= between[0]) & (F.col("ord") < between[1]))
    return dialogues


def needs_emotion(dialogues: DataFrame, mode: str = "person", narrator: str = T.NARRATOR) -> DataFrame:
    return dialogues if mode == "all" else dialogues.where((F.col("speaker") != "") & (F.col("speaker") != narrator))


def label_summary(results: DataFrame) -> DataFrame:
    """(book_id, total, success, fail); failed rows have evidence that starts with ``Error:``."""
    failed = F.coalesce(F.col("evidence").startswith("Error:"), F.lit(False))
    return results.groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("fail"))


def time_per_item(run_log: DataFrame) -> DataFrame:
    return run_log.groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("avg_seconds"))


def running_progress(run_log: DataFrame, width: int = RANGE) -> DataFrame:
    """Per processed row of a book: done, ok, failed, average seconds so far and what remains."""
    ok = (F.col("status") == "ok").cast("long")
    timed = F.col("seconds").isNotNull().cast("long")
    out = scan(run_log, "book_id", ["ord"], sums={"done": F.lit(1), "ok": ok, "_timed": timed, "_seconds": F.col("seconds")}, width=width)
    total = run_log.groupBy("book_id").agg(F.count("*").alias("total"))
    out = out.join(total.hint("merge"), "book_id")
    avg = F.when(F.col("_timed") > 0, F.col("_seconds") / F.col("_timed"))
    return out.select("book_id", "ord", "done", "ok", (F.col("done") - F.col("ok")).alias("fail"), F.round(avg, 4).alias("avg_seconds"), F.round(avg * (F.col("total") - F.col("done")), 4).alias("remaining_seconds"))


def progress_report(files: DataFrame, totals: DataFrame, now: int | None = None) -> DataFrame:
    """Progress of each book from its finished files (book_id, ord, length, modified_s).

    Elapsed time runs from the first to the last file by name, as the files are numbered.
    Times of day and the estimated end, reckoned from ``now`` in epoch seconds, are in UTC.
    """
    f = files.groupBy("book_id").agg(F.count("*").alias("done"), F.min_by("modified_s", "ord").alias("t0"), F.max_by("modified_s", "ord").alias("t1"))
    out = totals.join(f.hint("merge"), "book_id")
    elapsed = F.col("t1") - F.col("t0")
    avg = elapsed / F.col("done")
    left = F.col("total") - F.col("done")
    start = F.unix_timestamp() if now is None else F.lit(now)
    return out.select("book_id", "done", "total", left.alias("remaining"), F.round(100.0 * F.col("done") / F.col("total"), 4).alias("percent"), elapsed.alias("elapsed_s"), F.round(avg, 4).alias("avg_s"), F.round(avg * left, 4).alias("eta_s"),
        T.clock(F.col("t0")).alias("first_clock"), T.clock(F.col("t1")).alias("last_clock"), T.date_and_clock(start + avg * left).alias("estimated_end"))


def head_listing(dialogues: DataFrame, n: int = 10) -> DataFrame:
    return dialogues.where(F.col("ord") < n).select("book_id", "ord", "speaker", T.preview(F.col("text"), 30).alias("preview"), T.segment_path(F.col("ord")).alias("file"))


def line_slice(lines: DataFrame, labels: DataFrame, a: int, b: int) -> DataFrame:
    """Lines and labels of the positions [a, b) side by side; positions count from 0."""
    left = lines.withColumn("pos", F.col("line_no") - 1).where((F.col("pos") >= a) & (F.col("pos") < b)).select("book_id", "pos", "line")
    right = labels.where((F.col("ord") >= a) & (F.col("ord") < b)).select("book_id", F.col("ord").alias("pos"), "label")
    return left.join(right.hint("merge"), ["book_id", "pos"], "full")


def first_cooccurrence(dialogues: DataFrame, a: str, b: str, size: int = 10, width: int = RANGE) -> DataFrame:
    """(book_id, ord): the first row i < n - size with both speakers in the rows i .. i + size - 1.

    ``ord`` numbers the n rows of a book without gaps.
    """
    w = Window.partitionBy("book_id", AT).orderBy("ord").rowsBetween(0, size - 1)
    n = dialogues.groupBy("book_id").agg(F.count("*").alias("n"))
    both = F.max((F.col("speaker") == a).cast("int")).over(w) + F.max((F.col("speaker") == b).cast("int")).over(w)
    rows = with_neighbours(dialogues.select("book_id", "ord", "speaker"), "ord", size, max(size, width)).withColumn("both", both)
    first = rows.where("_own and both = 2").groupBy("book_id").agg(F.min("ord").alias("ord"))
    return first.join(n.hint("merge"), "book_id").where(F.col("ord") < F.col("n") - size).select("book_id", "ord")


def first_line_context(dialogues: DataFrame, speaker: str, before: int = 3, after: int = 7) -> DataFrame:
    """The rows around the first line of a speaker in each book."""
    first = dialogues.where(F.col("speaker") == speaker).groupBy("book_id").agg(F.min("ord").alias("hit"))
    rows = dialogues.join(first.hint("merge"), "book_id").where((F.col("ord") >= F.col("hit") - before) & (F.col("ord") <= F.col("hit") + after))
    return rows.select("book_id", "ord", "speaker", "text", (F.col("ord") == F.col("hit")).alias("is_hit"))
