"""Packing of token sequences: shallow patterns by non-negative least squares.

Documents are cut at the window length; what is left of each is one piece.  Only the
histogram of piece lengths (at most ``window`` numbers) reaches the driver.  There, patterns
of two or three lengths that fill a window are enumerated, their repeat counts are solved
against the histogram by non-negative least squares and rounded, and what is left of the
histogram is packed greedily, longest first.  Every pattern says for each of its lengths
which ranks it takes; the pieces are ranked within their length by Spark and look up their
place.  Ranks are counted per (length, salt), so a length that many documents have is dealt
over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import map_batches, save, sized
from .tokens import encoder

WINDOW = 2048
END_ID = 1
PER_SALT = 5_000
#: Bound on the patterns that are offered to the solver.
MOST_PATTERNS = 30_000


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window as far as the present lengths allow."""
    w = len(hist) - 1
    have = np.flatnonzero(hist[:w])
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 3), np.int64)
    fit = np.zeros(w + 1, np.int64)  # the longest present length up to x
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    two = np.stack([have, fit[w - have], np.zeros_like(have)], 1)
    per = max(1, MOST_PATTERNS // len(have))
    middle = have[np.unique(np.linspace(0, len(have) - 1, min(per, len(have))).astype(int))]
    a, b = (x.ravel() for x in np.meshgrid(have, middle))
    ok = a + b < w
    three = np.stack([a[ok], b[ok], fit[w - a[ok] - b[ok]]], 1)
    out = np.unique(np.sort(np.concatenate([two, three]), axis=1)[:, ::-1], axis=0)
    return out[(out[:, 1] > 0) & (w - out.sum(1) <= w // 64)]


def least_squares(pats: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that come near ``hist``, by accelerated projected gradients."""
    if not len(pats):
        return np.zeros(0)
    n = len(hist)
    target = hist.astype(float).copy()
    target[0] = 0

    def forward(x):
        out = np.bincount(pats.ravel(), np.repeat(x, 3), minlength=n)
        out[0] = 0
        return out

    v = np.ones(len(pats))
    for _ in range(20):  # the largest eigenvalue, for the step
        g = forward(v)[pats].sum(1)
        norm = np.linalg.norm(g)
        v = g / norm
    step, x, y, t = 1 / (norm * 1.05), np.zeros(len(pats)), np.zeros(len(pats)), 1.0
    for _ in range(rounds):
        r = target - forward(y)
        r[0] = 0
        new = np.maximum(0, y + step * r[pats].sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(hist: np.ndarray) -> tuple[list[tuple[list[tuple[int, int]], int]], int]:
    """([( [(length, times), ...], repeats )], number of sequences) that uses up ``hist``."""
    w, left = len(hist) - 1, hist.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(lengths: dict[int, int], most: int) -> None:
        n = min([most, *(int(left[k]) // m for k, m in lengths.items())])
        if n > 0:
            out.append((sorted(lengths.items(), reverse=True), n))
            for k, m in lengths.items():
                left[k] -= n * m

    if left[w]:
        use({w: 1}, int(left[w]))
    pats = patterns(left)
    counts = np.rint(least_squares(pats, left)).astype(np.int64)
    for i in np.lexsort((-counts, w - pats.sum(1))) if len(pats) else ():
        if counts[i]:
            lengths: dict[int, int] = {}
            for k in pats[i][pats[i] > 0].tolist():
                lengths[k] = lengths.get(k, 0) + 1
            use(lengths, int(counts[i]))
    have = np.flatnonzero(left[1:]) + 1
    while len(have):
        lengths, gap = {}, w
        at = len(have) - 1
        while at >= 0 and gap >= have[0]:
            at = min(at, int(np.searchsorted(have, gap, "right")) - 1)
            if at < 0:
                break
            k = int(have[at])
            m = min(gap // k, int(left[k]))
            lengths[k] = m
            gap -= m * k
            at -= 1
        use(lengths, int(left.sum()))
        have = have[left[have] > 0]
    return out, sum(n for _, n in out)


def lookup(steps: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in steps:
        offset = 0
        for k, m in lengths:
            rows.append((k, taken.get(k, 0), m, sequence, offset))
            taken[k] = taken.get(k, 0) + n * m
            offset += k * m
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end_id: int, window: int) -> Callable:
    def run(batches):
        ended = encoder(path).ended
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for lo, ids, at in ended(batch.column("text"), end_id):
                cols: list[list[int]] = [[], [], [], [], []]
                for doc, s, e in zip(docs[lo : lo + len(at) - 1], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for k in range(s, e, window):
                        part = ids[k : min(k + window, e)]
                        for c, v in zip(cols, (doc, k - s, len(part), zlib.crc32(part), e - s), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _place(table: np.ndarray) -> Callable:
    key = table[:, 0] << 48 | table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            step = table[np.searchsorted(key, length << 48 | rank, "right") - 1]
            n = rank - step[:, 1]
            seq = pa.array(step[:, 3] + n // step[:, 2])
            off = pa.array(step[:, 4] + n % step[:, 2] * length)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), seq, off], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    Null and empty texts have the end id alone.  Null ids are kept as they are.  Equal rows
    are packed each on its own.  Other columns are not read; an empty table gives no rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = save(map_batches(src, _pieces(tokenizer, end_id, window), PIECES), "pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``window`` rows
    hist = np.zeros(window + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["n"]
    steps, _ = plan(hist)
    salts = max(1, -(-int(hist.max()) // PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    at = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = save(at.select("length", "salt", "first"), "ranks")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(order))
    ranked = ranked.join(sized(at, window * salts), ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("first"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return map_batches(ranked, _place(lookup(steps)), f"{PIECES}, sequence_id long, offset long")
