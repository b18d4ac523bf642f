"""Composite jobs over the operators; those that ask a model run it when they are called, the others are lazy plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio, casting, context, labeling, parsing, stats, timeline
from ..sources import listing, scripts

PLACEHOLDER_MS = 1000


def parse_book(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Speaker statistics of parsed and labelled books."""
    return stats.speaker_counts(parsing.dialogue_table(lines, labels))


def synthesis_jobs(dialogues: DataFrame, genders: DataFrame, emotions: DataFrame, cast: DataFrame, default: DataFrame, files: DataFrame) -> DataFrame:
    """The jobs that are still to be done, with voice, style and text."""
    d = casting.pending_jobs(dialogues, files)
    d = casting.join_emotion(casting.cast_voice(casting.join_gender(d, genders), cast, default), emotions)
    d = d.withColumn("style", T.style_prefix(F.col("emotion"), F.col("tone")))
    return d.select("book_id", "ord", "chapter", "speaker", "ref_audio", "style", T.synthesis_text(F.col("style"), F.col("text")).alias("text"), T.segment_path(F.col("ord")).alias("output_path"))


def preset_jobs(dialogues: DataFrame, genders: DataFrame, clones: DataFrame, audio_files: DataFrame, files: DataFrame) -> DataFrame:
    """The jobs that are still to be done with either engine: text, chapter, place, voice and file."""
    d = casting.pending_jobs(dialogues, files)
    d = casting.assign_engine(casting.join_gender(d, genders), clones, audio_files)
    chapter = F.coalesce("chapter", F.lit("unknown")).alias("chapter")
    return d.select("book_id", "ord", chapter, "speaker", "text", "engine", "voice", T.segment_path(F.col("ord"), F.col("speaker")).alias("output_path"))


def volume_timeline(dialogues: DataFrame, files: DataFrame, durations: DataFrame, results: DataFrame) -> DataFrame:
    """Timeline of a volume from its dialogues; segments without a file or a good result are placeholders."""
    s = timeline.all_segments(dialogues, files).join(durations.select("book_id", "ord", "duration_ms").hint("merge"), ["book_id", "ord"])
    s = casting.reconcile_results(s.withColumn("engine", F.lit("clone")), results)
    s = s.withColumn("duration_ms", F.when(F.col("readable") & (F.col("placeholder_ms") == 0), F.col("duration_ms")).otherwise(PLACEHOLDER_MS).cast("long"))
    t = timeline.fade_plan(timeline.splice_timeline(s))
    return t.select("book_id", "ord", "chapter", "engine", "readable", "duration_ms", "gap_ms", "start_ms", "end_ms", "fade_ms")


def volume_report(dialogues: DataFrame, files: DataFrame, durations: DataFrame, results: DataFrame) -> DataFrame:
    """The chapters of the timeline, with length and size of their volume."""
    t = volume_timeline(dialogues, files, durations, results)
    stats = timeline.volume_stats(files, t).withColumnRenamed("duration_ms", "volume_ms")
    return timeline.chapter_manifest(t).join(stats.hint("merge"), "book_id")


def reference_clip_plan(samples: DataFrame, threshold: float, frame: int, hop: int, frame_ms: int) -> DataFrame:
    """Clips laid end to end from samples, with the share of speech in their source."""
    frames = audio.frame_rms(samples, frame, hop)
    merged = audio.merge_regions(audio.voiced_regions(frames, threshold, frame_ms))
    totals = frames.groupBy("clip_id").agg((F.count("*") * frame_ms).alias("total_ms"))
    stats = audio.speech_stats(merged, totals).select("clip_id", "regions", "speech_ms", "ratio")
    return audio.clip_plan(merged).join(stats.hint("merge"), "clip_id")


def dry_run_segments(dialogues: DataFrame) -> DataFrame:
    return dialogues.select("book_id", "ord", "chapter", "speaker", T.segment_path(F.col("ord"), F.col("speaker")).alias("audio_path"))


def label_genders(dialogues: DataFrame, factory: Callable[[], Callable], store: str, force: bool = False, **options) -> DataFrame:
    """(book_id, speaker, gender, confidence, evidence) of all named speakers; what ``store`` answers isn't asked again."""
    requests = labeling.gender_requests(context.character_corpus(dialogues))
    return labeling.parse_gender_reply(labeling.label_resumably(requests, factory, store, ["book_id", "speaker"], force=force, **options))


def label_emotions(dialogues: DataFrame, lines: DataFrame, factory: Callable[[], Callable], store: str, force: bool = False, **options) -> DataFrame:
    """(book_id, ord, emotion, tone, confidence, evidence) of what persons say; what ``store`` answers isn't asked again."""
    said = stats.needs_emotion(dialogues)
    requests = labeling.emotion_requests(said, context.context_window(said, lines))
    return labeling.parse_emotion_reply(labeling.label_resumably(requests, factory, store, ["book_id", "ord"], force=force, **options))


def folder_progress(spark: SparkSession, path: str, totals: DataFrame, number: str, book: str, now: int | None = None, manifest: str | None = None) -> DataFrame:
    """Progress of each book from the audio files below a folder, as they are when this is called.

    ``number`` and ``book`` find a segment's number and its book in the path of a file; contents aren't
    read, and empty files count as unfinished.  With ``manifest`` what is new since the last call is
    stored there, and the report reads the stored listing.
    """
    if manifest:
        listing.list_changes(spark, path, manifest, number)
    files = listing.read_manifest(spark, manifest) if manifest else scripts.scan_segment_files(spark, path, number)
    files = files.where("length > 0")
    files = files.select(F.regexp_extract("path", book, 1).try_cast("long").alias("book_id"), "ord", "length", F.col("modified").cast("long").alias("modified_s"))
    return stats.progress_report(files, totals, now)
