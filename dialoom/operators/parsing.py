"""Classification of lines, chapters, narration, and alignment of labels with dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import RANGE, number, scan

DIALOGUES = ["book_id", "ord", "line_no", "chapter", "text", "speaker"]



def classify_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(book_id, line_no, kind, text, speaker): the first rule that fits a stripped line."""
    s = F.col("s")
    trailing = T.TRAILING_SPEAKER_STRICT if strict else T.TRAILING_SPEAKER
    rules = [
        (s == "", "blank", F.lit(""), F.lit("")),
        (T.is_chapter(s), "chapter", s, F.lit("")),
        (s.rlike("(?U)" + trailing), "dialogue", F.regexp_extract(s, "(?U)" + trailing, 1), F.regexp_extract(s, "(?U)" + trailing, 2)),
        (s.rlike("(?U)" + T.SPEAKER_PREFIX), "dialogue", F.regexp_replace(F.regexp_extract(s, T.SPEAKER_PREFIX, 2), "」$", ""), F.regexp_extract(s, T.SPEAKER_PREFIX, 1)),
        (s.rlike("(?U)" + T.BARE_QUOTE), "dialogue", F.regexp_extract(s, "(?U)" + T.BARE_QUOTE, 1), F.lit("")),
        (s.rlike(T.INLINE_QUOTE), "dialogue", F.regexp_extract(s, T.INLINE_QUOTE, 1), F.lit("")),
    ]
    kind, text, speaker = F.lit("narrative"), s, F.lit("")
    for test, k, t, who in reversed(rules):
        kind, text, speaker = F.when(test, k).otherwise(kind), F.when(test, t).otherwise(text), F.when(test, who).otherwise(speaker)
    rows = lines.withColumn("s", T.strip(F.coalesce("line", F.lit(""))))
    return rows.select("book_id", "line_no", kind.alias("kind"), T.strip(text).alias("text"), T.strip(speaker).alias("speaker"))


def _heading() -> Column:
    return F.when(F.col("kind") == "chapter", F.col("text"))


def _is_kept(min_chars: int) -> Column:
    return (F.col("kind") == "dialogue") | ((F.col("kind") == "narrative") & (F.length("text") > min_chars))


def fill_chapter(parsed: DataFrame, width: int = RANGE) -> DataFrame:
    """Each line takes the latest heading at or above it; '' before the first."""
    rows = scan(parsed, "book_id", ["line_no"], latest={"chapter": _heading()}, width=width)
    return rows.withColumn("chapter", F.coalesce("chapter", F.lit("")))


def keep_narration(parsed: DataFrame, min_chars: int = 5, narrator: str = T.NARRATOR) -> DataFrame:
    """Dialogue rows, and narrative rows of more than ``min_chars`` characters as the narrator's."""
    return parsed.where(_is_kept(min_chars)).withColumn("speaker", F.when(F.col("kind") == "narrative", narrator).otherwise(F.col("speaker")))


def normalize_label(label: Column, non_person: str = T.NON_PERSON) -> Column:
    return F.when(F.coalesce(label, F.lit("")).isin("", non_person), "").otherwise(label)


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Speakers of the numbered dialogues by their label; without one the parsed speaker stays."""
    named = labels.select(F.col("book_id").alias("_b"), F.col("ord").alias("_k"), normalize_label(F.col("label")).alias("_label"), F.lit(True).alias("_hit"))
    joined = rows.join(named.hint("merge"), (rows.book_id == named._b) & (rows.k == named._k), "left")
    speaker = F.when(F.col("_hit"), F.col("_label")).otherwise(F.col("speaker"))
    return joined.withColumn("speaker", speaker).drop("_b", "_k", "_label", "_hit")


def align_labels(parsed: DataFrame, labels: DataFrame, mode: str = "line", width: int = RANGE) -> DataFrame:
    """Speakers from labels (book_id, ord, label).

    ``line``: the k-th dialogue line of a book takes label k; narration takes none, and
    behind the last label the parsed speaker stays.
    """
    if mode != "line":
        raise ValueError("quotes are aligned by align_quotes")
    is_dialogue = F.col("kind") == "dialogue"
    rows = number(parsed, "book_id", ["line_no"], "k", is_dialogue, width)
    return _named(rows.withColumn("k", F.when(is_dialogue, F.col("k"))), labels).drop("k")


def plain_quotes(lines: DataFrame, width: int = RANGE) -> DataFrame:
    """(book_id, k, line_no, text) of every quote, numbered through its book."""
    found = lines.select("book_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(T.ANY_QUOTE), F.lit(1))).alias("pos", "text"))
    return number(found, "book_id", ["line_no", "pos"], "k", width=width).select("book_id", "k", "line_no", "text")


def align_quotes(lines: DataFrame, labels: DataFrame, width: int = RANGE) -> DataFrame:
    """The k-th quote of a book's text takes label k; quotes behind the last label have ''."""
    named = labels.select("book_id", F.col("ord").alias("k"), normalize_label(F.col("label")).alias("speaker"))
    return plain_quotes(lines, width).join(named.hint("merge"), ["book_id", "k"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("")))


def dialogue_table(lines: DataFrame, labels: DataFrame, min_chars: int = 5, width: int = RANGE) -> DataFrame:
    """(book_id, ord, line_no, chapter, text, speaker): the parsed book.

    Chapters, label numbers and places in the table come from one pass over the ranges of a book.
    """
    is_dialogue, kept = F.col("kind") == "dialogue", _is_kept(min_chars)
    counts = {"k": is_dialogue.cast("long"), "ord": kept.cast("long")}
    rows = scan(classify_lines(lines), "book_id", ["line_no"], latest={"chapter": _heading()}, sums=counts, width=width).where(kept)
    rows = rows.withColumn("chapter", F.coalesce("chapter", F.lit(""))).withColumn("ord", F.col("ord") - 1).withColumn("k", F.when(is_dialogue, F.col("k") - 1))
    return keep_narration(_named(rows, labels), min_chars).select(DIALOGUES)


def extract_chapters(lines: DataFrame) -> DataFrame:
    s = T.strip(F.col("line"))
    return lines.where(T.is_chapter(s)).select("book_id", "line_no", s.alias("title"))


def missing_quotes(lines: DataFrame, parsed: DataFrame, preview: int = 100, width: int = RANGE) -> DataFrame:
    """(book_id, k, line_no, text, line, kind): quotes whose stripped text no parsed dialogue of the book has.

    Repeats are kept.  ``line`` is the quote's line, cut to ``preview`` characters, and ``kind`` what it
    was parsed as.
    """
    have = parsed.where("kind = 'dialogue'").select("book_id", "text").distinct()
    quotes = plain_quotes(lines, width).withColumn("text", T.strip(F.col("text")))
    missing = quotes.join(have.hint("merge"), ["book_id", "text"], "left_anti")
    around = lines.select("book_id", "line_no", T.preview(F.col("line"), preview).alias("line"))
    kinds = parsed.select("book_id", "line_no", "kind")
    return missing.join(around.hint("merge"), ["book_id", "line_no"]).join(kinds.hint("merge"), ["book_id", "line_no"]).select("book_id", "k", "line_no", "text", "line", "kind")


def extraction_report(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """(book_id, quotes, dialogues, missing)."""
    q = plain_quotes(lines).groupBy("book_id").agg(F.count("*").alias("quotes"))
    d = parsed.groupBy("book_id").agg(F.count_if(F.col("kind") == "dialogue").alias("dialogues"))
    m = missing_quotes(lines, parsed).groupBy("book_id").agg(F.count("*").alias("missing"))
    out = d.join(q.hint("merge"), "book_id", "left").join(m.hint("merge"), "book_id", "left")
    return out.select("book_id", F.coalesce("quotes", F.lit(0)).alias("quotes"), "dialogues", F.coalesce("missing", F.lit(0)).alias("missing"))
