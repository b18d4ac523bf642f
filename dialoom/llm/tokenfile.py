"""Token-id files: Simple-8b words in blocks, written and read by Spark.

A file is a Parquet table; a row of it is a *frame* of whole documents in ascending order of
their ids:

=========  ================================================================================
shard      number of the range of documents that the frame belongs to (ascending)
first      ids of the shard before the frame
doc_ids    the documents of the frame
counts     their numbers of ids
words      64-bit little-endian words: a 4-bit selector (high bits) and as many values of
           equal width as it says
blocks     for each block of ``BLOCK`` words, the number of ids before it, so that any range
           of ids is decoded from its own blocks
escapes    values of more than 60 bits, in order; selector 15 takes the next one
=========  ================================================================================
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import map_batches, new_path, sized
from .tokens import encoder

#: Values in a word and bits of each, by selector (fixed values of the coding).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0  # selector 0 would stand for 240 zeros; here it is a word with one escaped value
BLOCK = 128
FRAME_IDS = 1 << 16
END_ID = 2
#: Bytes of text for each shard at most, on average, and blocks that the reader decodes at once.
SHARD_BYTES = 256 << 20
READ_BLOCKS = 512


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, ids before each block, escaped values) of a sequence of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    big = ids >= np.uint64(1 << 60)
    bits = np.frexp(np.where(big, 0, ids).astype(np.float64))[1].astype(np.int8)
    low = np.where(big, 0, ids)
    bits[(bits > 0) & (low < (np.uint64(1) << np.maximum(bits - 1, 0).astype(np.uint64)))] -= 1
    bits[big] = 61
    # the widest selector is tried first; wherever a denser one fits it takes its place
    best = np.full(n, 15, np.int8)
    best[big] = ESCAPE
    widest, have = bits, 1
    for s in range(14, 0, -1):
        c = int(COUNTS[s])
        if c > n:
            break
        while have < c:
            step = min(have, c - have)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            have += step
        fits = widest <= WIDTHS[s]
        if not fits.any():
            break  # nor will longer runs of smaller values
        best[: len(widest)][fits] = s
    take = np.where(best == ESCAPE, 1, COUNTS[best])
    step, at, p = take.tolist(), [], 0
    while p < n:
        at.append(p)
        p += step[p]
    at = np.array(at)
    sel = best[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            continue
        value = words[rows]
        for j in range(int(COUNTS[s])):
            value |= ids[at[rows] + j] << np.uint64(j * int(WIDTHS[s]))
        words[rows] = value
    return words, at[::BLOCK].astype(np.uint32), ids[big]


def decode_words(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole words, uint64."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(sel == ESCAPE, 1, COUNTS[sel])
    stop = np.cumsum(count)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[stop[rows] - 1] = escapes[: len(rows)]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        shifts = np.arange(c, dtype=np.uint64) * np.uint64(w)
        out[(stop[rows] - c)[:, None] + np.arange(c)] = (words[rows][:, None] >> shifts) & np.uint64((1 << w) - 1)
    return out


def decode_range(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The ids [start, stop) of a frame, from the blocks that hold them."""
    lo = int(np.searchsorted(blocks, start, "right")) - 1
    hi = int(np.searchsorted(blocks, stop, "left"))
    skipped = int(np.count_nonzero(words[: lo * BLOCK] >> np.uint64(60) == ESCAPE))
    ids = decode_words(words[lo * BLOCK : hi * BLOCK], escapes[skipped:])
    return ids[start - int(blocks[lo]) : stop - int(blocks[lo])]


FILE = "shard int, first long, doc_ids array<long>, counts array<long>, words binary, blocks binary, escapes binary"


def _frames(path: str, end_id: int) -> Callable:
    def run(batches):
        ended = encoder(path).ended
        shard, first = TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def frame():
            words, blocks, escapes = encode_words(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([blocks.astype("<u4").tobytes()], pa.binary()), pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                ],
                names=["shard", "first", "doc_ids", "counts", "words", "blocks", "escapes"],
            )

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for lo, ids, at in ended(batch.column("text"), end_id):
                for doc, s, e in zip(ids_of[lo : lo + len(at) - 1], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if parts and size + e - s > FRAME_IDS:
                        yield frame()
                        first += size
                        docs, parts, size = [], [], 0
                    docs.append(doc)
                    parts.append(ids[s:e])
                    size += e - s
        if parts:
            yield frame()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the files in ascending order of doc_id.

    Null texts have the end id alone.  Rows of one id stand in the order of a hash of their
    texts, null ids first.  Long texts are encoded in parts and fill a frame of their own.
    Other columns are not read.  Shards are ranges of (doc_id, hash): whole texts are what is
    shuffled, which is less than their packed ids as Spark compresses both.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    key = ["doc_id", "tag"]
    ranged = src.withColumn("tag", F.xxhash64("text")).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    map_batches(ranged.select("doc_id", "text"), _frames(tokenizer, end_id), FILE).write.option("compression", "none").parquet(path)


def decoded(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, start: int, stop: int):
    """The ids [start, stop) of a frame in parts of at most ``READ_BLOCKS`` blocks."""
    while start < stop:
        lo = int(np.searchsorted(blocks, start, "right")) - 1
        end = int(blocks[lo + READ_BLOCKS]) if lo + READ_BLOCKS < len(blocks) else stop
        yield decode_range(words, blocks, escapes, start, min(end, stop))
        start = end


def _digests(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            words, blocks, escapes = (np.frombuffer(r[k], kind) for k, kind in (("words", "<u8"), ("blocks", "<u4"), ("escapes", "<u8")))
            parts = decoded(words, blocks, escapes, 0, sum(r["counts"]))
            held, at = next(parts), 0
            start = r["first"]
            for doc, n in zip(r["doc_ids"], r["counts"], strict=True):
                crc, left = 0, n
                while left:
                    if at == len(held):
                        held, at = next(parts), 0
                    take = held[at : at + left]
                    crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                    at, left = at + len(take), left - len(take)
                for c, v in zip(out, (r["shard"], doc, start, n, crc), strict=True):
                    c.append(v)
                start += n
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def _shards(files: DataFrame) -> tuple[DataFrame, int]:
    """(_shard, before): the ids of all shards before each; and the number of shards."""
    sizes = files.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    n_shards = sizes.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return sizes.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), n_shards


def read_ids(spark, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): the ids [start, stop) of the whole sequence, a row for each frame with some.

    Frames outside are skipped by their counts, and of the others only the blocks that hold
    the range are decoded.
    """
    files = spark.read.schema(FILE).parquet(path)
    sizes, n_shards = _shards(files)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = files.select("shard", "first", total.alias("n"), "words", "blocks", "escapes")
    rows = rows.join(sized(sizes, n_shards), rows.shard == sizes._shard)
    rows = rows.select((F.col("first") + F.col("before")).alias("first"), "n", "words", "blocks", "escapes").where((F.col("first") < stop) & (F.col("first") + F.col("n") > start))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, blocks, escapes = (np.frombuffer(r[k], kind) for k, kind in (("words", "<u8"), ("blocks", "<u4"), ("escapes", "<u8")))
                lo, hi = max(0, start - r["first"]), min(r["n"], stop - r["first"])
                ids = decode_range(words, blocks, escapes, lo, hi).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["first"] + lo], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["start", "ids"])

    return map_batches(rows, run, "start long, ids array<long>")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files at ``path``."""
    files = spark.read.schema(FILE).parquet(path)
    sizes, n_shards = _shards(files)
    rows = map_batches(files, _digests, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = rows.join(sized(sizes, n_shards), rows.shard == sizes._shard)
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the files of ``docs`` (to the shared folder if no path is given) and read them back."""
    path = path or new_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, path, end_id)
    return read_digests(docs.sparkSession, path)
