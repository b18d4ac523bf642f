"""Genders, voices, emotions and job lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import sized


#: Audio for the narrator and for each gender where a casting configuration names none.
PRESETS = {"narrator": "narrator.wav", "male": "male.wav", "female": "female.wav"}


def surest_gender(genders: DataFrame) -> tuple[list[str], DataFrame]:
    """The keys that verdicts hold for, and (*keys, _g): of several verdicts the surest."""
    keys = [c for c in ("book_id", "speaker") if c in genders.columns]
    sure = F.col("confidence") if "confidence" in genders.columns else F.lit(0.0)
    return keys, genders.groupBy(*keys).agg(F.max(F.struct(sure.alias("c"), "gender"))["gender"].alias("_g"))


def join_gender(dialogues: DataFrame, genders: DataFrame) -> DataFrame:
    """Gender by speaker, male where it is absent or unknown.

    Verdicts with a book_id hold for that book, others for all books.  Of several verdicts on
    a speaker the surest counts, so no dialogue is doubled.
    """
    keys, g = surest_gender(genders)
    known = F.when(F.col("_g") != "unknown", F.col("_g"))
    return dialogues.join(sized(g), keys, "left").withColumn("gender", F.coalesce(known, F.lit("male"))).drop("_g")


def cast_voice(df: DataFrame, cast: DataFrame, default: DataFrame, narrator: str = T.NARRATOR, presets: dict[str, str] = PRESETS) -> DataFrame:
    """ref_audio: for the narrator and empty speakers the narrator's, else the speaker's own or the gender's; and ``own_audio``.

    ``presets`` serve where the configuration has none: the narrator's never is that of a gender.
    """
    silent = F.coalesce("speaker", F.lit("")) == ""
    who = F.when(silent, narrator).otherwise(F.col("speaker"))
    own = sized(cast.select(F.col("speaker").alias("_who"), F.col("ref_audio").alias("_own")))
    usual = sized(default.select(F.col("gender").alias("_kind"), F.col("ref_audio").alias("_usual")))
    kind = F.when(F.col("gender") == "female", "female").otherwise("male")
    out = df.withColumn("_w", who).withColumn("_k", kind)
    out = out.join(own, out._w == own._who, "left").join(usual, F.col("_k") == usual._kind, "left")
    by_gender = F.coalesce("_usual", F.when(F.col("_k") == "female", presets["female"]).otherwise(presets["male"]))
    usual_audio = F.when(F.col("_w") == narrator, presets["narrator"]).otherwise(by_gender)
    return out.withColumn("ref_audio", F.coalesce("_own", usual_audio)).withColumn("own_audio", F.col("_own").isNotNull()).drop("_w", "_k", "_who", "_own", "_kind", "_usual")


def assign_engine(df: DataFrame, clones: DataFrame, audio: DataFrame, listed: DataFrame | None = None, male: str = "male_voice", female: str = "female_voice") -> DataFrame:
    """engine and voice: speakers with a reference that is one of the files ``audio`` (path) are cloned,
    others get a preset by gender.

    With ``listed`` only the speakers in it have a gender of their own; others get the male preset.
    """
    there = clones.join(sized(audio.select(F.col("path").alias("ref_audio")).distinct()), "ref_audio", "left_semi")
    out = df.join(sized(there.select("speaker", F.col("ref_audio").alias("_ref"))), "speaker", "left")
    is_male = F.col("gender") == "male"
    if listed is not None:
        out = out.join(sized(listed.select("speaker").distinct().withColumn("_listed", F.lit(True))), "speaker", "left")
        is_male = F.col("_listed").isNull() | is_male
    engine = F.when(F.col("_ref").isNotNull(), "clone").otherwise("preset")
    return out.withColumn("engine", engine).withColumn("voice", F.coalesce("_ref", F.when(is_male, male).otherwise(female))).drop("_ref", "_listed")


def join_emotion(dialogues: DataFrame, emotions: DataFrame, narrator: str = T.NARRATOR) -> DataFrame:
    """emotion and tone by (book_id, ord); the narrator and the empty speaker have none."""
    e = emotions.select("book_id", "ord", F.col("emotion").alias("_e"), F.col("tone").alias("_t"))
    speaks = (F.col("speaker") != "") & (F.col("speaker") != narrator)
    out = dialogues.join(e.hint("merge"), ["book_id", "ord"], "left")
    return out.withColumn("emotion", F.when(speaks, F.col("_e"))).withColumn("tone", F.when(speaks, F.col("_t"))).drop("_e", "_t")


def pending_jobs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs without a finished file (one of more than 0 bytes)."""
    return jobs.join(files.where("length > 0").select("book_id", "ord").hint("merge"), ["book_id", "ord"], "left_anti")


def reconcile_results(jobs: DataFrame, results: DataFrame, placeholder_ms: int = 1000) -> DataFrame:
    """Jobs with their result; failed and absent ones go to the fallback engine with a placeholder."""
    r = results.select("book_id", "ord", "status")
    out = jobs.join(r.hint("merge"), ["book_id", "ord"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    bad = F.col("status") != "ok"
    return out.withColumn("engine", F.when(bad, "fallback").otherwise(F.col("engine"))).withColumn("placeholder_ms", F.when(bad, placeholder_ms).otherwise(0).cast("long"))
