"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are cut into segments; for each the mean and the deviation are kept.  For vectors q
and x of one length, the inner product of a segment is at most m * (mean_q * mean_x +
dev_q * dev_x), with m its length (Cauchy and Schwarz on what is left of the means), which
bounds the distance from below.  Coarse segments are tried first; pairs whose bound
can't reach the k-th best score known are dropped, finer segments follow, and the survivors
get their exact integer scores.

Queries and candidates are packed into blocks of bounded rows and bytes, near vectors together, in
the narrowest integers that hold them.  The best scores of a query within its own block are a floor
of its k best.  A block of candidates is summed up by the range of its means and its largest
deviation in each segment, which bound every pair with it: only blocks whose bound reaches a floor
of a block of queries are sent there, and only the k best of each query leave a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import map_batches, save

QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 16_384
#: Bytes of the vectors in a block, as 64-bit numbers.
BLOCK_BYTES = 16 << 20
LEVELS = (4, 16)
#: Vectors that others are put next to, and their bytes as 64-bit numbers; they decide which rows share a block, not the results.
PIVOTS, PIVOT_BYTES = 64, 4 << 20
#: Summaries of blocks that one task compares with a block of queries at a time.
PAGE = 1_024
SCALE = 256.0
LARGEST = np.finfo(np.float64).max
MOST = 2**63 - 1


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest of three types that holds whole numbers, and their bytes."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _rows(pivots: dict[int, np.ndarray]) -> Callable:
    """Rows of whole numbers, each with the pivot that it is nearest to."""
    half = {d: (p**2).sum(1) / 2 for d, p in pivots.items()}

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            at = at - at[0]
            with np.errstate(over="ignore", invalid="ignore"):
                ints = np.clip(np.floor(np.asarray(flat, np.float64) * SCALE), -LARGEST, LARGEST)
                dims = np.diff(at)
                cells = np.zeros(len(dims), np.int32)
                for d in set(dims.tolist()) & set(pivots):
                    some = np.flatnonzero(dims == d)
                    x = ints[at[some][:, None] + np.arange(d)] if d else np.zeros((len(some), 0))
                    cells[some] = (x @ pivots[d].T - half[d]).argmax(1)
            coded = [_narrow(ints[at[i] : at[i + 1]]) for i in range(len(dims))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array([k for k, _ in coded]), pa.array([r for _, r in coded], pa.binary())],
                names=["vec_id", "dim", "cell", "kind", "row"],
            )

    return run


def summary(x: np.ndarray) -> np.ndarray:
    """Largest and least means and largest deviations of the segments of a block, weighted as in ``statistics``."""
    s = statistics(x, LEVELS[-1])
    return np.concatenate([s[:, 0::2].max(0), s[:, 0::2].min(0), s[:, 1::2].max(0)])


def bounds(q: np.ndarray, summaries: np.ndarray) -> np.ndarray:
    """What no inner product of a query with a vector of a block exceeds, from statistics and summaries."""
    mean = q[:, 0::2]
    return np.concatenate([np.maximum(mean, 0), np.minimum(mean, 0), q[:, 1::2]], 1) @ summaries.T


def _blocks(size: int, name: str) -> Callable:
    def run(batches):
        # vectors of one length go together; a block holds whole rows only
        held: dict[int, list] = {}

        def block(d):
            ids, rows = zip(*held.pop(d), strict=True)
            x = np.stack(rows)
            kind, packed = _narrow(x)
            with np.errstate(over="ignore", invalid="ignore"):
                stats = summary(x) if name == "c" else statistics(x, LEVELS[-1])
            names = ["dim", f"{name}_kind", f"{name}_ids", f"{name}_rows", f"{name}_stats"]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([kind]), *(pa.array([v], pa.binary()) for v in (np.array(ids, "<i8").tobytes(), packed, stats.astype("<f8").tobytes()))], names=names)

        for batch in batches:
            for vec_id, d, kind, row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "kind", "row")), strict=True):
                held.setdefault(d, []).append((vec_id, np.frombuffer(row, kind).astype(np.float64)))
                if len(held[d]) >= max(1, min(size, BLOCK_BYTES // max(8, 8 * d))):
                    yield block(d)
        for d in list(held):
            yield block(d)

    return run


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that a product of rows is the bound."""
    cut = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        part = x[:, s:e]
        root = np.sqrt(e - s)
        out += [part.mean(1) * root, part.std(1) * root]
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def products(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of the pairs a[row], b[col]; by one matrix product where the pairs are many."""
    if 32 * len(row) > len(a) * len(b):
        return (a @ b.T)[row, col]
    return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", a[row[i : i + 200_000]], b[col[i : i + 200_000]]) for i in range(0, len(row), 200_000))])


def best(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels=LEVELS):
    """(query's place, candidate's id, score) of each query's k best candidates of at least its floor, ties to the least id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    with np.errstate(over="ignore"):
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    exact = largest < 2**52
    if largest > 1e300:  # doubles can't hold the bounds: all pairs get their exact score
        levels, floors = (), np.full(len(q), -np.inf)
    stats = [(statistics(q, s), statistics(c, s)) for s in levels]
    out = [[], [], []]
    for lo in range(0, len(q), 256):
        mine = q[lo : lo + 256]
        own = q_ids[lo : lo + 256, None] == c_ids[None, :]
        bound = stats[0][0][lo : lo + 256] @ stats[0][1].T if stats else np.zeros((len(mine), len(c)))
        bound[own] = -np.inf
        top = min(len(c), 4 * k)
        guess = np.argpartition(-bound, top - 1, axis=1)[:, :top]
        known = np.einsum("qd,qnd->qn", mine, c[guess]) if stats else np.full(guess.shape, -np.inf)
        known[np.take_along_axis(own, guess, 1)] = -np.inf
        floor = np.sort(known, axis=1)[:, -k] if top >= k else np.full(len(mine), -np.inf)
        floor = np.maximum(floor, floors[lo : lo + 256])
        slack = 1e-9 * (np.abs(bound[np.isfinite(bound)]).max(initial=0) + np.abs(floor[np.isfinite(floor)]).max(initial=0) + 1) + 1e-6
        row, col = np.nonzero((bound >= floor[:, None] - slack) & ~own)
        for qs, cs in stats[1:]:
            keep = products(qs[lo : lo + 256], cs, row, col) >= floor[row] - slack
            row, col = row[keep], col[keep]
        if exact:
            score = products(mine, c, row, col).astype(np.int64)
            near = score >= floor[row]  # the k best are among these
            row, col, score = row[near], col[near], score[near]
        else:  # beyond the integers of a double
            score = np.array([sum(int(a) * int(b) for a, b in zip(mine[r], c[j], strict=True)) for r, j in zip(row, col, strict=True)], object)
        rank = np.lexsort((col, -score, row)) if exact else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], col[i])), int)
        row, col, score = row[rank], col[rank], score[rank]
        first = np.searchsorted(row, np.arange(len(mine)))
        keep = np.arange(len(row)) - first[row] < k if len(row) else np.zeros(0, bool)
        for o, v in zip(out, (lo + row[keep], c_ids[col[keep]], score[keep]), strict=True):
            o.append(v)
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _vectors(r: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a block."""
    ids = np.frombuffer(r[f"{name}_ids"], "<i8")
    return ids, np.frombuffer(r[f"{name}_rows"], r[f"{name}_kind"]).reshape(len(ids), r["dim"]).astype(np.float64)


def _floors(k: int) -> Callable:
    """Query blocks, each query with the k-th best score that it has in its own block."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                q_ids, q = _vectors(r, "q")
                floors = np.full(len(q), -np.inf)
                at, _, score = best(q_ids, q, floors, q_ids, q, k)
                full = np.bincount(at.astype(np.int64), minlength=len(q)) == k
                last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.zeros(0, np.int64)
                last = last[full[at[last].astype(np.int64)]]
                floors[at[last].astype(np.int64)] = [_as_double(s) for s in score[last].tolist()]
                out.append(floors.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "q_floors"])

    return run


def _meeting(batches):
    """(q_block, c_block) of the pairs that may hold one of the k best."""
    for batch in batches:
        for r in batch.to_pylist():
            floors = np.frombuffer(r["q_floors"], "<f8")
            q = np.frombuffer(r["q_stats"], "<f8").reshape(len(floors), -1)
            c = np.frombuffer(b"".join(p["c_stats"] for p in r["page_of"]), "<f8").reshape(len(r["page_of"]), -1)
            with np.errstate(over="ignore", invalid="ignore"):
                bound = bounds(q, c)
                slack = 1e-9 * (np.abs(bound) + np.abs(floors)[:, None]) + 1e-6
                meets = ~(bound < floors[:, None] - slack).all(0)  # what isn't a number meets too
            ids = [p["c_block"] for p, m in zip(r["page_of"], meets, strict=True) if m]
            yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["q_block", "c_block"])


def _as_double(score: int) -> float:
    return float(max(-(10**308), min(10**308, score)))


def _compare(k: int) -> Callable:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (q_ids, q), (c_ids, c) = _vectors(r, "q"), _vectors(r, "c")
                if len(q) and len(c):
                    at, ids, score = best(q_ids, q, np.frombuffer(r["q_floors"], "<f8"), c_ids, c, k)
                    found = score.tolist()
                    long = [s if -MOST - 1 <= s <= MOST else None for s in found]
                    # beyond a long the rank goes by a double
                    size = np.array([_as_double(s) for s in found], np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(long, pa.int64()), pa.array(size)], names=["query_id", "vec_id", "score", "size"])

    return run


def _pivots(v: DataFrame) -> dict[int, np.ndarray]:
    """At most ``PIVOTS`` vectors by a hash of their id, by length, as whole numbers."""
    some = v.where(F.size("vec") <= PIVOT_BYTES // (8 * PIVOTS)).select("vec", F.xxhash64("vec_id").alias("_h")).orderBy("_h").limit(PIVOTS)
    out: dict[int, list] = {}
    for r in some.toLocalIterator():
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(np.array(r["vec"], np.float64) * SCALE), -LARGEST, LARGEST)
        if np.abs(x).max(initial=0) < 1e150:
            out.setdefault(len(x), []).append(x)
    return {d: np.unique(np.stack(x), axis=0) for d, x in out.items()}


def _pairs(q: DataFrame, c: DataFrame) -> DataFrame:
    """(q_block, c_block) of blocks of one length that have to meet, found from summaries of the blocks of candidates.

    The summaries go in pages of bounded rows to the statistics of each block of queries; vectors don't move.
    """
    n_pages = max(1, -(-c.count() // PAGE))
    pages = c.select("dim", "c_block", "c_stats").withColumn("page", F.pmod(F.xxhash64("c_block"), F.lit(n_pages)))
    pages = pages.groupBy("dim", "page").agg(F.collect_list(F.struct("c_block", "c_stats")).alias("page_of"))
    ids = q.groupBy("dim").agg(F.collect_list("q_block").alias("q_blocks"))
    grid = pages.join(ids.hint("merge"), "dim").withColumn("q_block", F.explode("q_blocks")).drop("dim", "q_blocks")
    asked = q.select("q_block", "q_stats", "q_floors").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))))
    return map_batches(asked.join(grid.hint("merge"), ["q_block", "page"]), _meeting, "q_block long, c_block long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query.

    Components become floor(256 * x); queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows of the query's length with another id.  Null vectors, null
    ids and vectors with a null or non-finite component take no part.  Ties go to the smaller
    id.  A repeated row counts as often as it stands, as a candidate and as a query; the
    copies take a place each, so the k best rows of each pair of blocks are enough.  Empty
    vectors meet each other with score 0.  A score beyond a long is null; those are ranked as
    doubles, and components whose 256-fold is beyond a double count as the largest one.
    """
    spark = vectors.sparkSession
    raw = F.col("embedding").cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), raw.alias("vec")).where("vec_id is not null and vec is not null").where(~bad)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = "vec_id long, dim int, cell int, kind string, row binary"
    # near rows in one place; those of one cell, and rows that repeat, are spread over as many partitions as they fill
    code = _rows(_pivots(v))
    rows, asked = (map_batches(d, code, row).withColumn("_at", F.xxhash64("vec_id", F.monotonically_increasing_id())) for d in (v, v.where(F.col("vec_id") % every == 0)))
    kind = "dim int, {0}_kind string, {0}_ids binary, {0}_rows binary, {0}_stats binary"
    n_queries = v.where(F.col("vec_id") % every == 0).count()
    q = asked.repartitionByRange(max(1, -(-n_queries // QUERY_BLOCK)), "dim", "cell", "_at").sortWithinPartitions("dim", "cell")
    q = map_batches(map_batches(q, _blocks(QUERY_BLOCK, "q"), kind.format("q")), _floors(k), kind.format("q") + ", q_floors binary")
    q = save(q.withColumn("q_block", F.monotonically_increasing_id()), "queries")
    c = rows.repartitionByRange(parts, "dim", "cell", "_at").sortWithinPartitions("dim", "cell")
    c = save(map_batches(c, _blocks(CANDIDATE_BLOCK, "c"), kind.format("c")).withColumn("c_block", F.monotonically_increasing_id()), "blocks")
    pairs = save(_pairs(q, c), "pairs").withColumn("lane", F.pmod(F.xxhash64("c_block"), F.lit(parts)))
    # a block of queries goes to the lanes of the candidates that it meets, not to each candidate
    lanes = q.drop("dim", "q_stats").join(pairs.select("q_block", "lane").distinct().hint("merge"), "q_block")
    pairs = c.drop("c_stats").join(pairs.hint("merge"), "c_block").join(lanes.hint("merge"), ["q_block", "lane"])
    pairs = pairs.select("dim", "q_kind", "q_ids", "q_rows", "q_floors", "c_kind", "c_ids", "c_rows")
    found = map_batches(pairs, _compare(k), "query_id long, vec_id long, score long, size double")
    # as doubles first, which never contradicts the order of longs, then exactly
    order = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
