"""Voiced regions in frame-level series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import AT, RANGE, scan, with_neighbours


def frame_rms(samples: DataFrame, frame: int = 2048, hop: int = 512, width: int = RANGE) -> DataFrame:
    """(clip_id, frame_idx, rms) of centred, zero-padded frames from (clip_id, sample_idx, v).

    Squares are summed once per hop; a frame is the sum of its hops, so samples aren't repeated.
    Ranges of hops share those that a frame over their border needs.
    """
    per = frame // hop
    hops = samples.groupBy("clip_id", F.floor(F.col("sample_idx") / hop).cast("long").alias("h")).agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    last = samples.groupBy("clip_id").agg(F.floor((F.max("sample_idx") + 1) / hop).cast("long").alias("n"))
    # all hops of a clip, through its ranges: no cell holds a whole clip
    ranges = last.select("clip_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / width).cast("long"))).alias("r"))
    all_hops = ranges.select("clip_id", F.explode(F.sequence(F.col("r") * width, F.least(F.col("n"), F.col("r") * width + width - 1))).alias("h"))
    rows = all_hops.join(hops.hint("merge"), ["clip_id", "h"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    w = Window.partitionBy("clip_id", AT).orderBy("h").rowsBetween(-(per // 2), per - per // 2 - 1)
    found = with_neighbours(rows, "h", per, width).withColumn("rms", F.sqrt(F.sum("e").over(w) / frame))
    return found.where("_own").select("clip_id", F.col("h").alias("frame_idx"), "rms")


def voiced_regions(frames: DataFrame, threshold: float = 0.01, frame_ms: int = 100, width: int = RANGE) -> DataFrame:
    """(clip_id, start_ms, end_ms): maximal runs above the threshold.

    A region ends at the first quiet frame, or at the last frame if the clip ends with it.  Runs are
    numbered through the ranges of a clip, so one that reaches over borders is one region.
    """
    loud = F.col("rms") > threshold
    rows = scan(frames.withColumn("loud", F.coalesce(loud, F.lit(False))), "clip_id", ["frame_idx"], before={"_was": F.col("loud")}, after={"_next": F.col("frame_idx")}, width=width)
    new = (F.col("loud") & ~F.coalesce("_was", F.lit(False))).cast("long")
    rows = scan(rows, "clip_id", ["frame_idx"], sums={"run": new}, width=width).where("loud")
    runs = rows.groupBy("clip_id", "run").agg(F.min("frame_idx").alias("a"), F.max(F.coalesce("_next", "frame_idx")).alias("b"))
    return runs.select("clip_id", (F.col("a") * frame_ms).alias("start_ms"), (F.col("b") * frame_ms).alias("end_ms"))


def merge_regions(regions: DataFrame, max_gap_ms: int = 300, width: int = 1000 * RANGE) -> DataFrame:
    """Neighbours with a gap strictly below ``max_gap_ms`` become one; ``width`` in milliseconds."""
    rows = scan(regions.select("clip_id", "start_ms", "end_ms"), "clip_id", ["start_ms"], before={"_end": F.col("end_ms")}, width=width)
    gap = F.col("start_ms") - F.col("_end")
    rows = scan(rows, "clip_id", ["start_ms"], sums={"run": (gap.isNull() | (gap >= max_gap_ms)).cast("long")}, width=width)
    return rows.groupBy("clip_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("run")


def clip_plan(regions: DataFrame, pause: int = 100, cap: int = 30_000, width: int = 1000 * RANGE) -> DataFrame:
    """Places of the regions laid end to end with pauses, cut at ``cap`` milliseconds."""
    size = F.col("end_ms") - F.col("start_ms")
    rows = scan(regions.select("clip_id", "start_ms", "end_ms"), "clip_id", ["start_ms"], sums={"_upto": size + pause}, width=width)
    rows = rows.withColumn("clip_start", F.col("_upto") - size - pause).where(F.col("clip_start") < cap)
    return rows.select("clip_id", "start_ms", "end_ms", "clip_start", F.least(F.col("clip_start") + size, F.lit(cap)).alias("clip_end"))


def speech_stats(regions: DataFrame, totals: DataFrame) -> DataFrame:
    """(clip_id, regions, speech_ms, silence_ms, ratio) with totals (clip_id, total_ms)."""
    r = regions.groupBy("clip_id").agg(F.count("*").alias("regions"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    out = totals.join(r.hint("merge"), "clip_id", "left").na.fill(0, ["regions", "speech_ms"])
    ratio = F.when(F.col("total_ms") > 0, F.round(F.col("speech_ms") / F.col("total_ms"), 4)).otherwise(0.0)
    return out.select("clip_id", "regions", "speech_ms", (F.col("total_ms") - F.col("speech_ms")).alias("silence_ms"), ratio.alias("ratio"))


def longest_region(regions: DataFrame) -> DataFrame:
    size = F.col("end_ms") - F.col("start_ms")
    best = F.max_by(F.struct("start_ms", "end_ms"), F.struct(size, -F.col("start_ms"))).alias("r")
    return regions.groupBy("clip_id").agg(best).select("clip_id", "r.*")
