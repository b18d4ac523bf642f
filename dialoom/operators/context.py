"""Keyword search, line ranges and context windows, and the texts rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import AT, RANGE, scan, with_neighbours
from .stats import first_n

BUCKET = 64


def context_window(dialogues: DataFrame, lines: DataFrame, k: int = 30, center: str = "line_no", few: bool = False, width: int = RANGE) -> DataFrame:
    """(book_id, ord, context): lines L-k .. L+k as ``no: stripped``, joined by line feeds.

    One pass of a sliding window over ranges of the lines of a book, those near a border in both
    ranges; a request meets its line by equality.  With ``few``, for requests on a small part
    of the lines, only the lines in buckets near a request get a window.
    """
    at = F.col(center) + (0 if center == "line_no" else 1)
    want = dialogues.select("book_id", "ord", at.cast("long").alias("line_no"))
    if few:
        bucket = F.floor(F.col("line_no") / BUCKET)
        touched = want.select("book_id", F.explode(F.sequence(F.floor((F.col("line_no") - k) / BUCKET), F.floor((F.col("line_no") + k) / BUCKET))).alias("bucket")).distinct()
        lines = lines.withColumn("bucket", bucket).join(touched.hint("merge"), ["book_id", "bucket"], "left_semi").drop("bucket")
    shown = F.format_string("%d: %s", "line_no", T.strip(F.coalesce("line", F.lit(""))))
    near = Window.partitionBy("book_id", AT).orderBy("line_no").rangeBetween(-k, k)
    have = with_neighbours(lines.select("book_id", "line_no", shown.alias("shown")), "line_no", k, max(k, width))
    have = have.withColumn("context", F.array_join(F.collect_list("shown").over(near), "\n")).where("_own").select("book_id", "line_no", "context")
    return want.join(have.hint("merge"), ["book_id", "line_no"]).select("book_id", "ord", "context")


def keyword_search(lines: DataFrame, keywords: list[str], limit: int = 20, preview: int = 120, also: str | None = None) -> DataFrame:
    """(keyword, book_id, line_no, line, total, truncated): the first lines with each keyword.

    Lines are shown stripped and cut to ``preview`` characters.  Keywords may hold one another;
    each is tested on its own.  With ``also``, stripped lines need to hold that too.
    """
    shown = T.strip(F.col("line"))
    text = shown if also else F.col("line")
    rows = lines.where(F.contains(text, F.lit(also))) if also else lines

    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))
    rows = rows.select("book_id", "line_no", T.preview(shown, preview).alias("shown"), F.explode(hits).alias("keyword"))
    totals = rows.groupBy("keyword", "book_id").agg(F.count("*").alias("total"))
    first = first_n(rows, ["keyword", "book_id"], ["line_no"], limit).join(totals.hint("merge"), ["keyword", "book_id"])
    return first.select("keyword", "book_id", "line_no", F.col("shown").alias("line"), "total", (F.col("total") > limit).alias("truncated"))


def mention_dialogues(lines: DataFrame, names: list[str], limit: int = 50) -> DataFrame:
    """Lines with a name and an opening quote, the first of each book, stripped and cut to 120 characters."""
    return keyword_search(lines, names, limit, also="「")


def read_range(lines: DataFrame, requests: DataFrame, limit: int = 300) -> DataFrame:
    """(book_id, start, end, text, truncated) of requests (book_id, start, end), both inclusive.

    A range join by buckets of line numbers.  Requests of unknown books and empty ranges have
    an empty text; repeated requests are answered each.
    """
    keys = ["book_id", "start", "end"]
    last = lines.groupBy("book_id").agg(F.max("line_no").alias("last"))
    want = requests.select(keys).distinct().join(last.hint("merge"), "book_id", "left")
    want = want.withColumn("lo", F.greatest("start", F.lit(1))).withColumn("hi", F.coalesce(F.least("end", "last"), F.lit(0)))
    upto = F.least(F.col("hi"), F.col("lo") + limit - 1)
    some = want.where("lo <= hi").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(upto / BUCKET))))
    have = lines.withColumn("bucket", F.floor(F.col("line_no") / BUCKET))
    rows = some.join(have.hint("merge"), ["book_id", "bucket"]).where((F.col("line_no") >= F.col("lo")) & (F.col("line_no") <= upto))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.format_string("%d: %s", "line_no", T.strip(F.coalesce("line", F.lit("")))).alias("shown"))))
    text = rows.groupBy(keys).agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "\n").alias("text"))
    found = want.join(text.hint("merge"), keys, "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"), (F.col("hi") - F.col("lo") + 1 > limit).alias("truncated"))
    return requests.select(keys).join(found.hint("merge"), keys)


def locate_text(dialogues: DataFrame, needles: list[str], before: int = 3, after: int = 3) -> DataFrame:
    """(needle, book_id, ord, speaker, text, is_hit): the first dialogue with each needle, and its neighbours."""
    hits = F.filter(F.array(*map(F.lit, needles)), lambda k: F.contains(F.col("text"), k))
    first = dialogues.select("book_id", "ord", F.explode(hits).alias("needle")).groupBy("needle", "book_id").agg(F.min("ord").alias("hit"))
    near = first.withColumn("ord", F.explode(F.sequence(F.col("hit") - before, F.col("hit") + after)))
    rows = near.join(dialogues.select("book_id", "ord", "speaker", "text").hint("merge"), ["book_id", "ord"])
    return rows.select("needle", "book_id", "ord", "speaker", "text", (F.col("ord") == F.col("hit")).alias("is_hit"))


def character_corpus(dialogues: DataFrame, n: int = 50) -> DataFrame:
    """(book_id, speaker, corpus, lines): the first n texts of each named speaker."""
    rows = first_n(dialogues.where("speaker <> ''"), ["book_id", "speaker"], ["ord"], n)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy("book_id", "speaker").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("corpus"), F.count("*").alias("lines"))


def _shown(matches: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.format_string("Line %d: %s", "line_no", "line").alias("s"))))
    return matches.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n").alias("body"), F.count("*").alias("shown"), F.max("total").alias("total"))


def render_search(matches: DataFrame, asked: DataFrame) -> DataFrame:
    """(keyword, book_id, output) for each asked (keyword, book_id), those without a match included."""
    m = asked.join(_shown(matches, ["keyword", "book_id"]).hint("merge"), ["keyword", "book_id"], "left")
    head = F.format_string("Found %d matches", F.coalesce("total", F.lit(0)))
    some = F.when(F.col("total") > F.col("shown"), F.format_string(" (showing %d of %d)", "shown", "total")).otherwise("")
    found = F.coalesce(F.concat(F.lit(":\n"), "body"), F.lit("\nNo matches found"))
    output = F.concat(head, some, found)
    return m.select("keyword", "book_id", output.alias("output"))


def render_range(ranges: DataFrame) -> DataFrame:
    text = F.concat("text", F.when(F.col("truncated"), "\n... (truncated)").otherwise(""))
    return ranges.select("book_id", "start", "end", F.when(text == "", "No lines in range").otherwise(text).alias("output"))


def render_mentions(matches: DataFrame, asked: DataFrame) -> DataFrame:
    m = asked.join(_shown(matches, ["keyword", "book_id"]).hint("merge"), ["keyword", "book_id"], "left")
    output = F.when(F.col("body").isNull(), F.format_string("No dialogues found for '%s'", "keyword")).otherwise(F.concat(F.format_string("Found %d dialogues:\n", "shown"), "body"))
    return m.select("keyword", "book_id", output.alias("output"))


def gender_cues(lines: DataFrame, names: list[str], he: str, she: str, near: int = 1) -> DataFrame:
    """(keyword, book_id, he, she): pattern counts in the lines with a name and ``near`` lines around."""
    hits = F.filter(F.array(*map(F.lit, names)), lambda k: F.contains(F.col("line"), k))
    at = lines.select("book_id", "line_no", F.explode(hits).alias("keyword"))
    around = at.select("keyword", "book_id", F.explode(F.sequence(F.col("line_no") - near, F.col("line_no") + near)).alias("line_no")).distinct()
    rows = around.join(lines.hint("merge"), ["book_id", "line_no"])

    def count(p: str) -> Column:
        return F.sum(F.size(F.regexp_extract_all("line", F.lit(p), F.lit(0)))).cast("long")

    return rows.groupBy("keyword", "book_id").agg(count(he).alias("he"), count(she).alias("she"))


def emotion_cues(dialogues: DataFrame, cue: str, width: int = RANGE) -> DataFrame:
    """Signs in a dialogue, whether the rows before and behind it are the narrator's, and matches of ``cue`` in those."""

    def count(p: str) -> Column:
        return F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")

    told = F.col("speaker") == T.NARRATOR
    cues = F.struct(told.alias("told"), F.when(told, count(cue)).alias("cues"))
    rows = scan(dialogues, "book_id", ["ord"], before={"_above": cues}, after={"_below": cues}, width=width)
    return rows.select(
        "book_id", "ord", count("[!！]").alias("exclaims"), count("[?？]").alias("asks"), count("…").alias("pauses"), count("[.,]").alias("stops"),
        F.coalesce("_above.told", F.lit(False)).alias("told_before"), F.coalesce("_below.told", F.lit(False)).alias("told_after"),
        F.coalesce("_above.cues", F.lit(0)).alias("cues_before"), F.coalesce("_below.cues", F.lit(0)).alias("cues_after"),
    )
