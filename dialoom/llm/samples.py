"""Bounded samples of labelled rows, for training."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The most labels that are learned: those of the most rows, of equal ones the least.
MOST_LABELS = 200
PARTS = 16


def fold(id_col: str, k: int) -> F.Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def labelled_texts(docs: DataFrame, labels: DataFrame, per_label: int, most_bytes: int) -> pa.Table:
    """Arrow table (text, label) of at most ``per_label`` ids for each label of (doc_id, label).

    The ids are the first by a hash of the id among those with a text of at most ``most_bytes``
    bytes, so the sample is the same in each run; labels beyond ``MOST_LABELS`` are left out.
    The bounds are parameters of the models; what the driver holds is at most
    MOST_LABELS * per_label * most_bytes.
    """
    spread = F.xxhash64("doc_id")
    short = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).select("doc_id", F.col("text").cast("string").alias("text"))
    # ids whose text can be used, before any is picked
    usable = labels.where("doc_id is not null and label is not null").join(short.select("doc_id").hint("merge"), "doc_id", "left_semi")
    some = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    # limited within each task, then within parts of a label, so no label is gathered whole
    ids = some.withColumn("part", F.pmod(spread, F.lit(PARTS)))
    for key in (["label", "part"], ["label"]):
        n = F.row_number().over(Window.partitionBy(*key).orderBy(spread, "doc_id"))
        ids = ids.withColumn("n", n).where(F.col("n") <= per_label).drop("n")
    ids = ids.drop("part")
    often = ids.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).select("label")
    ids = ids.join(F.broadcast(often), "label")
    # bounded by MOST_LABELS * per_label rows of two values
    return short.join(F.broadcast(ids), "doc_id").orderBy(spread, "doc_id", "text").select("text", "label").toArrow()
