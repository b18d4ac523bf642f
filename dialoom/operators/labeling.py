"""Model labelling as a Spark job: requests, a batched call, and replies.

The model is a callable that a factory makes once for each partition; Spark builds the
requests and parses the replies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import new_folder

VERDICT = "character_name string, gender string, confidence double, evidence string"
MOOD = "emotion string, tone string, confidence double, evidence string"


def gender_requests(corpus: DataFrame) -> DataFrame:
    """(book_id, speaker, request) from a character corpus."""
    return corpus.select("book_id", "speaker", F.format_string("Character: %s\nLines: %d\n%s", "speaker", "lines", "corpus").alias("request"))


def emotion_requests(dialogues: DataFrame, contexts: DataFrame) -> DataFrame:
    """(book_id, ord, request) of dialogues with their context windows."""
    rows = dialogues.join(contexts.hint("merge"), ["book_id", "ord"])
    return rows.select("book_id", "ord", F.format_string("Speaker: %s\nDialogue: %s\nContext:\n%s", "speaker", "text", "context").alias("request"))


def apply_model(requests: DataFrame, factory: Callable[[], Callable], batched: bool = False) -> DataFrame:
    """``requests`` with reply and status; an exception makes an error row, and the job goes on.

    With ``batched`` the model gets the requests of a batch as a list and gives a list of as
    many replies, an exception standing for a reply that failed.
    """
    keys = [f for f in requests.schema if f.name != "request"]

    def attempt(model: Callable, asked):
        try:
            return model(asked)
        except Exception as e:  # any failure of the user's model is a row
            return e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            asked = pdf["request"].tolist()
            found = attempt(model, asked) if batched else [attempt(model, r) for r in asked]
            if isinstance(found, Exception) or len(found) != len(asked):
                found = [found if isinstance(found, Exception) else ValueError("not as many replies as requests")] * len(asked)
            failed = [isinstance(r, Exception) for r in found]
            replies = [f"Error: {r}" if bad else r for r, bad in zip(found, failed, strict=True)]
            yield pdf.drop(columns="request").assign(reply=replies, status=["error" if bad else "ok" for bad in failed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return requests.mapInPandas(run, f"{schema}, reply string, status string")


def parse_gender_reply(replies: DataFrame) -> DataFrame:
    """gender, confidence and evidence from (…, speaker, reply); unknown becomes male, at 0.3 at least."""
    v = T.json_in_text(F.col("reply"), VERDICT)
    whole = v["character_name"].isNotNull() & v["gender"].isNotNull()
    gender = F.when(whole, v["gender"]).otherwise("unknown")
    confidence = F.when(whole, F.coalesce(v["confidence"], F.lit(0.0))).otherwise(0.0)
    evidence = F.when(whole, F.coalesce(v["evidence"], F.lit(""))).otherwise("no verdict")
    unknown = gender == "unknown"
    keep = [c for c in replies.columns if c not in ("reply", "status")]
    return replies.select(*keep, F.when(unknown, "male").otherwise(gender).alias("gender"), F.when(unknown, F.greatest(confidence, F.lit(0.3))).otherwise(confidence).alias("confidence"), evidence.alias("evidence"))


def parse_emotion_reply(replies: DataFrame) -> DataFrame:
    """emotion, tone, confidence and evidence; calm, serious and 0 where there is no verdict."""
    v = T.json_in_text(F.col("reply"), MOOD)
    keep = [c for c in replies.columns if c not in ("reply", "status")]
    return replies.select(*keep, F.coalesce(v["emotion"], F.lit("calm")).alias("emotion"), F.coalesce(v["tone"], F.lit("serious")).alias("tone"), F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(v["evidence"], F.lit("")).alias("evidence"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_answers(spark: SparkSession, store: str, keys: list[str]) -> DataFrame | None:
    """(*keys, asked, reply, status, run) of the newest generation in a store, one row for each request.

    Of several answers to a request the one of the last run counts.  None if there is no answer yet.
    """
    if not _exists(spark, store):
        return None
    found = spark.read.option("mergeSchema", "false").parquet(store)
    if "generation" not in found.columns:
        return None
    newest = found.agg(F.max("generation")).first()[0]
    if newest is None:
        return None
    last = F.max(F.struct("run", "status", "reply")).alias("a")
    rows = found.where(F.col("generation") == newest).groupBy(*keys, "asked").agg(last)
    return rows.select(*keys, "asked", "a.reply", "a.status", "a.run")


def label_resumably(
    requests: DataFrame, factory: Callable[[], Callable], store: str, keys: list[str], *, batched: bool = False, force: bool = False, retry_errors: bool = False, per_task: int = 64,
) -> DataFrame:
    """(*keys, reply, status) of requests (*keys, request), asking a model only what the folder ``store`` doesn't answer.

    Each task asks at most ``per_task`` requests and its answers stay once it has ended, also when
    the job fails later or executors are lost: the next call reads them and asks for the rest.  A
    request whose text has changed is asked again.  Answers that are errors count, unless
    ``retry_errors``.  ``force`` begins a new generation, in which all is asked anew; a forced run
    that failed is taken up by a call without ``force``.  Null keys and null requests are left
    out, and repeated ones are asked once.  This runs jobs when it is called.

    Tasks commit straight to the store (version 2 of Hadoop's file committer); a task that ran
    twice leaves the same request twice, which ``stored_answers`` folds.
    """
    spark = requests.sparkSession
    asked = F.xxhash64("request").alias("asked")
    there = F.col("request").isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    folder = new_folder(spark, "requests")
    requests.where(there).select(*keys, "request", asked).dropDuplicates([*keys, "asked"]).write.parquet(folder)
    wanted = spark.read.parquet(folder)  # made once, though asked for below too
    known = stored_answers(spark, store, keys)
    pending, generation, run = wanted, 0, 0
    if known is not None:
        newest = spark.read.parquet(store).agg(F.max(F.struct("generation", "run"))).first()[0]
        generation, run = newest.generation + int(force), newest.run + 1
    if known is not None and not force:
        done = known.where("status = 'ok'") if retry_errors else known
        rest = new_folder(spark, "pending")
        wanted.join(done.select(*keys, "asked").hint("merge"), [*keys, "asked"], "left_anti").write.parquet(rest)
        pending = spark.read.parquet(rest)
    n = pending.count()
    if n:
        answers = apply_model(pending.repartition(-(-n // per_task)), factory, batched)
        answers.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(f"{store}/generation={generation}/run={run}")
    # answers to these requests only: the store may hold others
    asked_for = wanted.select(*keys, "asked")
    found = stored_answers(spark, store, keys)
    if found is None:
        return asked_for.select(*keys, F.lit("").alias("reply"), F.lit("").alias("status")).where(F.lit(False))
    return asked_for.join(found.hint("merge"), [*keys, "asked"]).select(*keys, "reply", "status")
