"""Mixing of sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken target / source_size times.  The whole part is
taken at once; the fractional parts are rounded in pairs: mass, in words, moves at random
between the two until one of them is taken or left as a whole, so the words of a source
stay the same through all steps and each document keeps its expected copies.  Groups of
bounded size are reduced by tasks to one open document each, and the open ones are paired
again, level by level, until one is left for a source; only that one is rounded freely.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, save, sized

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST_COPIES = 2.0
GROUP = 10_000
FAN_IN = 1_000
#: Of more than BROADCAST_ROWS sources, those with a larger part of the documents than 1 / SHARE are broadcast.
SHARE = 100_000
#: Equal rows that are expanded at once.
STEP = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, 0 for null, without splitting it."""
    # a sign for each word with the blanks behind it; blanks before the first word are trimmed
    signs = F.regexp_replace(text, WORD + r"+[\x20\x09-\x0D]*+", "w")
    return F.coalesce(F.length(F.btrim(signs, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, docs) from (source, source_size, docs), one row for each source.

    Sources in code point order, null last, have the weights in turn.  A target is
    least(most * source_size, level * weight); the level is raised, with a pass over the
    sources each time, until what the capped ones leave is reshared and no other is above.
    """
    # Spark compares strings by their UTF-8 bytes, which is the order of code points
    ordered = save(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "sources")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = ordered.groupBy("_p").agg(F.count("*").alias("n")).select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    w = ordered.withColumn("_i", place).join(first.hint("merge"), "_p").withColumn("_i", F.col("_i") + F.col("first"))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_i") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    w = save(w.select("source", "source_size", "docs", "weight", "cap"), "weights")
    words, level, capped = None, 0.0, -1
    while True:
        full = F.col("cap") < level * F.col("weight")
        n, all_words, taken, open_weight = w.agg(
            F.count_if(full), F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        words = words or all_words or 0
        if n == capped or not open_weight:
            break
        capped, level = n, (total * words - (taken or 0.0)) / open_weight
    return w.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"), "docs")


def _pair(final: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds one group; its last open row stays open, or is rounded freely if ``final``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # largest first, so that what stays open in the end is small
        pdf = pdf.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, a, u = pdf["part"].to_numpy().copy(), pdf["size"].to_numpy(np.float64), pdf["draw"].to_numpy()
        i = -1
        for j in range(len(p)):
            if i < 0:
                i = j
                continue
            to_i = min(a[i] * (1 - p[i]), a[j] * p[j])
            to_j = min(a[i] * p[i], a[j] * (1 - p[j]))
            if u[j] * (to_i + to_j) < to_j:
                whole_i, whole_j = to_i >= a[i] * (1 - p[i]), to_i >= a[j] * p[j]
                p[i] = 1.0 if whole_i else p[i] + to_i / a[i]
                p[j] = 0.0 if whole_j else p[j] - to_i / a[j]
            else:
                whole_i, whole_j = to_j >= a[i] * p[i], to_j >= a[j] * (1 - p[j])
                p[i] = 0.0 if whole_i else p[i] - to_j / a[i]
                p[j] = 1.0 if whole_j else p[j] + to_j / a[j]
            if whole_i:
                i = -1 if whole_j else j
        if i >= 0 and final:
            p[i] = float((u[i] * 1e6) % 1.0 < p[i])
            i = -1
        pdf["part"] = p
        pdf["open"] = np.arange(len(p)) == i
        return pdf

    return run


def _with_targets(base: DataFrame, targets: DataFrame) -> DataFrame:
    """``base`` with the columns of its source in ``targets``; no source is gathered in one task."""
    here = targets.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    n = targets.count()
    if n <= BROADCAST_ROWS:
        return base.join(F.broadcast(here), same).drop("_s")
    # sources of many documents are few: at most as many as SHARE says
    docs = targets.agg(F.sum("docs")).first()[0]
    large = F.col("docs") * SHARE > docs
    hot = base.join(F.broadcast(here.where(large)), same)
    rest = base.join(F.broadcast(here.where(large).select("_s")), same, "left_anti").join(here.where(~large).hint("merge"), same)
    return hot.unionByName(rest).drop("_s")


def _rounded(docs: DataFrame, weights, total: float, most: float) -> DataFrame:
    """(doc_id, tag, size, source, rows, source_size, target, copies): equal rows are one, with their number."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.hash("text").alias("tag"))
    base = save(base.groupBy("doc_id", "tag", "size", "source").agg(F.count("*").alias("rows")), "sizes")
    counted = base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("docs"))
    targets = save(source_targets(counted, weights, total, most), "targets")

    times = F.when(F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = _with_targets(base, targets)
    rows = rows.withColumn("times", times).withColumn("whole", F.floor("times").cast("long")).withColumn("part", F.col("times") - F.col("whole"))
    seed = F.xxhash64(F.lit("mix"), "doc_id", "tag", "source")
    rows = rows.withColumn("draw", (F.shiftrightunsigned(seed, 11)).cast("double") / F.lit(float(2**53)))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "tag", "size"), F.greatest(F.ceil(F.col("docs") / GROUP), F.lit(1))).cast("long"))
    columns = ["doc_id", "tag", "size", "source", "rows", "source_size", "target", "docs", "whole", "part", "draw", "group"]
    rows = rows.select(columns)
    fixed = (F.col("part") <= 0) | (F.col("size") == 0)
    settled = [rows.where(fixed).withColumn("part", F.lit(0.0))]
    todo = rows.where(~fixed)
    schema = "doc_id long, tag int, size long, source string, rows long, source_size long, target double, docs long, whole long, part double, draw double, group long, open boolean"
    groups = targets.agg(F.coalesce(F.max(F.ceil(F.col("docs") / GROUP)), F.lit(1))).first()[0]
    while True:
        final = groups <= 1
        level = todo.groupBy("source", "group").applyInPandas(_pair(final), schema)
        level = save(level, "rounded")
        settled.append(level.where(~F.col("open")).select(columns))
        if final:
            break
        todo = level.where("open").withColumn("group", F.floor(F.col("group") / FAN_IN).cast("long")).select(columns)
        groups = -(-groups // FAN_IN)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = (F.col("whole") + F.round("part").cast("long")).alias("copies")
    return out.select("doc_id", "tag", "size", "source", "rows", "source_size", "target", copies)


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """(doc_id, tag, size, source, source_size, target, copies) for each row of ``docs``.

    Reads doc_id, source and text; ``tag`` is a hash of the text.  Null texts have size 0;
    rows without words get the whole part of their source's copies.  Null ids and sources
    are allowed, a null source being a source of its own.  Equal rows are rounded together
    and share their copies evenly.  The draws follow from id, source and text, so reruns
    agree.  Texts of any length are one item; other columns are not read.
    """
    out = _rounded(docs, weights, total, most)
    # the rows that are equal again, in steps of bounded arrays
    out = out.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(STEP).cast("long"))))
    out = out.withColumn("_n", F.explode(F.sequence(F.col("_s"), F.least(F.col("rows"), F.col("_s") + STEP) - 1)))
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("_n") < F.col("copies") % F.col("rows")).cast("long")
    return out.select("doc_id", "tag", "size", "source", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns stay."""
    taken = _rounded(docs, weights, total, most).groupBy("doc_id", "tag").agg(F.sum("copies").alias("copies"), F.sum("rows").alias("rows"))
    taken = save(taken.withColumnRenamed("doc_id", "_id").withColumnRenamed("tag", "_tag"), "copies")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.hash("text").alias("_own"))

    def with_copies(t: DataFrame) -> DataFrame:
        same = keyed.doc_id.cast("long").eqNullSafe(F.col("_id")) & keyed._own.eqNullSafe(F.col("_tag"))
        return keyed.join(sized(t, t.count()), same)

    one = with_copies(taken.where("rows = 1")).select("row", "copies")
    several = taken.where("rows > 1")
    if several.limit(1).count():
        # numbered within the partition they are written from, as one text may stand very often
        some = save(with_copies(several).withColumn("_p", F.spark_partition_id()), "repeated")
        key = ["_id", "_tag"]
        before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        first = some.groupBy(*key, "_p").agg(F.count("*").alias("n")).select(F.col("_id").alias("_i"), F.col("_tag").alias("_t"), F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_p").orderBy("_own")) - 1)
        some = some.join(first.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_tag").eqNullSafe(F.col("_t")) & (F.col("_p") == F.col("_q")))
        share = F.floor(F.col("copies") / F.col("rows")) + (F.col("_n") + F.col("first") < F.col("copies") % F.col("rows")).cast("long")
        one = one.unionByName(some.select("row", share.alias("copies")))
    # a copy of each row that is taken: shuffled no further
    one = one.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return one.select("row.*")
