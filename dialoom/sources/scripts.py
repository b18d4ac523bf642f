"""Sources and sinks of scripts, labels, results, voices and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.scan import number
from .lines import numbered_lines, read_lines
from .tables import character_audio, dense_ids, relational_tables, write_tables
from .voices import merge_voices, read_registry, read_voices, upsert_voices, write_registry, write_voice_list

__all__ = ["character_audio", "dense_ids", "merge_voices", "numbered_lines", "read_lines", "read_registry", "read_voices", "relational_tables", "upsert_voices", "write_registry", "write_tables", "write_voice_list"]

GENDERS = "map<string,struct<gender:string,confidence:double>>"
EMOTION = "struct<emotion:string,tone:string,confidence:double,evidence:string>"
EMOTION_ROW = "struct<index:bigint,emotion:string,tone:string,confidence:double,evidence:string>"


def number_labels(lines: DataFrame) -> DataFrame:
    """(book_id, ord, label): blank lines are dropped before labels are numbered."""
    rows = lines.withColumn("label", T.strip(F.col("line"))).where("label <> ''")
    return number(rows, "book_id", ["line_no"], "ord").select("book_id", "ord", "label")


def read_speaker_labels(spark: SparkSession, path: str) -> DataFrame:
    return number_labels(read_lines(spark, path))


def gender_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """Rows (…, speaker, gender, confidence) of JSON maps name to verdict."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.explode(F.from_json(col, GENDERS)).alias("speaker", "v")).select(*keep, "speaker", "v.gender", "v.confidence")


def _results(spark: SparkSession, path: str, per_line: bool) -> DataFrame:
    """(book_id, value) of files of one JSON value each, book_id only if they lie in folders
    ``book_id=...``; or, ``per_line``, of lines as ``write_labels_json`` writes them."""
    if per_line:
        return spark.read.schema("book_id long, value string").json(path)
    df = spark.read.text(path, wholetext=True)
    return df.withColumn("book_id", F.col("book_id").cast("long")) if "book_id" in df.columns else df


def read_gender_results(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(book_id, speaker, gender, confidence) of files that map names to verdicts."""
    return gender_rows(_results(spark, path, per_line))


def emotion_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """Rows (…, ord, emotion, tone, confidence, evidence) of either shape of results file:
    a map from index to verdict, or a list of rows that carry their index."""
    keep = [c for c in df.columns if c != col]
    results = df.select(*keep, F.get_json_object(col, "$.results").alias("r"))
    listed = F.ltrim("r").startswith("[")
    fields = ["emotion", "tone", "confidence", "evidence"]
    of_map = results.where(~listed).select(*keep, F.explode(F.from_json("r", f"map<string,{EMOTION}>")).alias("k", "v"))
    of_map = of_map.select(*keep, F.col("k").cast("long").alias("ord"), *[f"v.{c}" for c in fields])
    of_list = results.where(listed).select(*keep, F.explode(F.from_json("r", f"array<{EMOTION_ROW}>")).alias("v"))
    return of_map.union(of_list.select(*keep, F.col("v.index").alias("ord"), *[f"v.{c}" for c in fields]))


def read_emotion_results(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(book_id, ord, emotion, tone, confidence, evidence) of files of either shape."""
    return emotion_rows(_results(spark, path, per_line))


def gender_json(genders: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON map for each of ``keys`` from rows (…, speaker, gender, confidence)."""
    entry = F.struct("speaker", F.struct("gender", "confidence"))
    return genders.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def emotion_json(rows: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """One results file for each of ``keys``: shape "map", or "list" with totals and enums."""
    fields = ["emotion", "tone", "confidence", "evidence"]
    if shape == "map":
        entry = F.struct(F.col("ord").cast("string"), F.struct(*fields))
        body = F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("results"))
    else:
        failed = F.col("evidence").startswith("Error:")
        body = F.struct(
            F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("fail"),
            F.array(*map(F.lit, T.EMOTIONS)).alias("emotions"), F.array(*map(F.lit, T.TONES)).alias("tones"),
            F.array_sort(F.collect_list(F.struct(F.col("ord").alias("index"), *fields))).alias("results"),
        )
    return rows.groupBy(*keys).agg(F.to_json(body).alias("value"))


def write_labels_json(df: DataFrame, path: str) -> None:
    """A line (book_id, value) for the results of each book, so that books don't make tiny files."""
    df.select("book_id", "value").write.json(path)


#: Entries of a configuration whose table is broadcast; they are counted where they are given.
BROADCAST_ENTRIES = 100_000


def casting_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(speaker, ref_audio) and (gender, ref_audio) of a casting configuration."""

    def table(entries: dict, key: str) -> DataFrame:
        df = spark.createDataFrame(list(entries.items()), f"{key} string, ref_audio string")
        return F.broadcast(df) if len(entries) <= BROADCAST_ENTRIES else df

    return table(config.get("characters", {}), "speaker"), table(config.get("default_audio", {}), "gender")


def scan_segment_files(spark: SparkSession, path: str, number: str = r"/(\d+)[^/]*\.wav$") -> DataFrame:
    """(path, ord, length, modified) of the audio files below a folder; contents are not read.

    ``number`` finds the segment's number in a path; files without one are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", number, 1)
    return files.select("path", stem.try_cast("long").alias("ord"), "length", F.col("modificationTime").alias("modified")).where(stem != "")


def write_segments(segments: DataFrame, path: str) -> None:
    """All segments in files as large as their partitions, however many books there are."""
    segments.write.json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ord long, chapter string, speaker string, audio_path string, book_id long").json(path)


def debug_listing(dialogues: DataFrame, start: int, end: int) -> DataFrame:
    """(book_id, row, listing): four header lines, then ``[n] speaker: text`` of the rows [start, end).

    A missing speaker is shown as ``?``, an empty one as it is.
    """
    rows = dialogues.where((F.col("ord") >= start) & (F.col("ord") < end))
    body = rows.select("book_id", (F.col("ord") + 4).alias("row"), F.format_string("[%d] %s: %s", "ord", F.coalesce("speaker", F.lit("?")), "text").alias("listing"))
    people = F.count_distinct(F.when(F.col("speaker") != "", F.col("speaker")))
    books = rows.groupBy("book_id").agg(F.count("*").alias("n"), people.alias("people"))
    # fixed values: the header of the listing
    head = F.array(F.lit(f"对话范围: {start}-{end}"), F.format_string("共 %d 条对话, %d 个角色", "n", "people"), F.lit("=" * 60), F.lit(""))
    first = books.select("book_id", F.posexplode(head).alias("row", "listing"))
    return first.withColumn("row", F.col("row").cast("long")).union(body)


def bracket_labels(lines: DataFrame) -> DataFrame:
    """(book_id, ord, label) from lines with ``【speaker|alias】「text」``, in order."""
    hit = lines.select("book_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(T.BRACKET_SPEAKER), F.lit(1))).alias("pos", "name"))
    return number(hit, "book_id", ["line_no", "pos"], "ord").select("book_id", "ord", F.substring_index("name", "|", 1).alias("label"))
