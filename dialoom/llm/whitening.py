"""Whitening of embeddings by their leading components, found by Chebyshev-filtered subspace iteration.

Vectors become integers; each distinct one is fitted once.  The covariance is never formed:
a pass over blocks of the fit list gives the centred product X'(XQ) for a narrow Q, summed in
tasks and then over tasks.  A Chebyshev recurrence of such passes damps the eigenvalues below a
cut, QR and Rayleigh-Ritz follow, and the cut moves up with the Ritz values, until the residual
of each wanted component is as small as rounding allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_batches, save

SCALE = 256
#: Rows of a block, and the bytes that they take as 64-bit numbers.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 8 << 20
#: Width of the subspace beside the wanted components; a wide one lets the filter be short.
GUARD = 28
DEGREE = 10
BOUND_STEPS = 6
MOST_CYCLES = 40
#: Residuals, in parts of the largest eigenvalue, at which a component counts as found.
TOLERANCE = 5e-14
#: An eigenvalue below this part of the trace counts as zero.
RANK_TOLERANCE = 1e-13
#: Partial sums that one task adds up.
FAN_IN = 64
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Whitening:
    """The fit: n vectors of ``dim`` entries with exact sums; components are the columns of ``axes``."""

    n: int
    dim: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds null or non-finite entries.

    Entries become floor(scale * c) as long, held within the range of a long.
    """
    raw = F.col("embedding").cast("array<double>")
    bad = F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # spelled on doubles, whose cast to long saturates
    x = F.transform("c", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return vectors.select("vec_id", raw.alias("c")).where("c is not null").where(~bad).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _blocks(dim: int) -> Callable:
    """Rows of x packed as matrices of the narrowest integers that hold them."""
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))

    def pack(rows: list[np.ndarray]):
        m = np.concatenate(rows)
        kind = next(k for k in ("<i2", "<i4", "<i8") if m.min() >= np.iinfo(k).min and m.max() <= np.iinfo(k).max)
        return pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int32()), pa.array([kind]), pa.array([m.astype(kind).tobytes()], pa.binary())], names=["rows", "kind", "body"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            m = _matrix(batch.column("x"), dim)
            while len(m):
                part, m = m[: size - n], m[size - n :]
                held.append(part)
                n += len(part)
                if n == size:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return run


def _each(batches, dim: int):
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["body"], r["kind"]).reshape(r["rows"], dim)


def _sum_partials(batches):
    total = None
    for batch in batches:
        for body in batch.column("body").to_pylist():
            part = np.frombuffer(body, "<f8")
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["body"])


def _reduced(blocks: DataFrame, part: Callable, shape: tuple[int, ...], parts: int) -> np.ndarray:
    """The sum over all blocks of ``part`` (a matrix of ``shape``): in tasks, then over groups of tasks.

    What reaches the driver is a matrix for each of at most FAN_IN groups.
    """

    def run(batches):
        total = np.zeros(shape)
        for m in batches:
            total += part(m)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["body"])

    dim = shape[0]
    out = blocks.mapInArrow(lambda batches: run(_each(batches, dim)), "body binary")
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts).mapInArrow(_sum_partials, "body binary")
    rows = out.collect()  # at most FAN_IN matrices
    return np.sum([np.frombuffer(r.body, "<f8") for r in rows], axis=0).reshape(shape)


def _exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Sums of the columns without rounding: high and low halves are added by Spark."""

    def run(batches):
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for m in _each(batches, dim):
            m = m.astype(np.int64)
            high += (m >> 32).sum(0)
            low += (m & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(high), pa.array(low)], names=["j", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = blocks.mapInArrow(run, "j int, high long, low long").groupBy("j").agg(*wide).collect()  # one row a dimension
    return [int(r.high) * 2**32 + int(r.low) for r in sorted(rows, key=lambda r: r.j)]


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, guard: int = GUARD, degree: int = DEGREE, seed: int = 1):
    """(values, vectors, residuals) of the k largest eigenpairs of a positive semidefinite map, given by its products.

    The wanted ones are the columns of a filtered subspace of k + guard columns.  With as many
    columns as dimensions the first projection is already exact.
    """
    rng = np.random.default_rng(seed)
    width = min(dim, k + guard)
    low = 0.0
    if width < dim:
        low = _lower_bound(product, rng.standard_normal(dim), min(BOUND_STEPS, dim))
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    for cycle in range(MOST_CYCLES):
        vq = product(q)
        small = q.T @ vq
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        q, vq = q @ s, vq @ s
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * theta[:k], axis=0)
        done = residual <= TOLERANCE * max(theta[0], np.finfo(float).tiny) * np.sqrt(dim)
        if width == dim or done.all() or theta[0] <= 0:
            break
        if cycle and residual.max() > 0.5 * last and residual.max() < 1e-11 * theta[0]:
            break  # rounding lets it go no further
        last = residual.max()
        cut, low = theta[-1], min(low, theta[-1])
        if cut <= low:
            low = 0.0
        if cut <= 0:  # the rest is zero: the subspace already holds all of the range
            break
        q = np.linalg.qr(chebyshev(product, q, vq, degree, low, cut, theta[0]))[0]
    return theta[:k], q[:, :k], residual


def chebyshev(product: Callable, q: np.ndarray, vq: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """A polynomial of the map applied to q (with its product vq): small on [low, cut], steeply growing above.

    The recurrence is scaled by its value at ``top``, so that it doesn't overflow.
    """
    half, mid = (cut - low) / 2, (cut + low) / 2
    if half <= 0:
        return vq
    sigma = half / (top - mid)
    first = sigma
    x, y = q, (vq - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        x, y = y, (product(y) - mid * y) * (2 * new / half) - (sigma * new) * x
        sigma = new
    return y


def _lower_bound(product: Callable, v: np.ndarray, steps: int) -> float:
    """An estimate from below of the least eigenvalue, by a few Lanczos steps."""
    basis = [v / np.linalg.norm(v)]
    alpha, beta = [], []
    for _ in range(steps):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for b in basis:
            w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    theta, s = np.linalg.eigh(t)
    return max(0.0, float(theta[0] - beta[-1] * abs(s[-1, 0])))


def fit(x: DataFrame, components: int = 4) -> Whitening | None:
    """The fit of ``x`` (vec_id, x), over each distinct vector once.

    Vectors of the length that most distinct vectors have (of equal ones the longer) are fitted.
    None if there is no vector, or only empty ones.  Components with a zero eigenvalue are left out.
    """
    distinct = save(x.select("x").distinct(), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim, n = sizes.dim, sizes.n
    blocks = save(map_batches(distinct.where(F.size("x") == dim), _blocks(dim), "rows int, kind string, body binary"), "fit-blocks")
    parts = blocks.rdd.getNumPartitions()
    sums = _exact_sums(blocks, dim)
    mean = np.array([float(s) for s in sums]) / n
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(m):
            c = m - mean
            return c.T @ (c @ q)

        return _reduced(blocks, part, q.shape, parts) / n

    squares = _reduced(blocks, lambda m: ((m - mean) ** 2).sum(0), (dim,), parts) / n
    trace = float(squares.sum())
    if trace <= 0:
        return Whitening(n, dim, sums, np.zeros((dim, 0)), np.zeros(0), trace)
    values, axes, residual = leading_pairs(product, dim, min(components, dim))
    real = values > RANK_TOLERANCE * trace
    values, axes = values[real], axes[:, real]
    if (residual[real] > 1e-10 * values[0]).any():
        raise ArithmeticError(f"components not certified: residuals {residual}")
    found = Whitening(n, dim, sums, axes, values, trace, passes=passes)
    scaled = axes / np.sqrt(values)
    white = scaled.T @ product(scaled)
    found.identity_error = float(np.abs(white - np.eye(len(values))).max(initial=0.0))
    return found


def whiten(x: DataFrame, w: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    ``deviation`` is exact; it is null where it is beyond a long.  Rows of another length than
    the fitted one have no result.
    """
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return x.sparkSession.createDataFrame([], kind)
    mean = np.array([float(s) for s in w.sums]) / w.n
    scaled, k, most_sum = w.axes / np.sqrt(w.values), len(w.values), max(map(abs, w.sums))

    def deviations(m: np.ndarray) -> list:
        largest = int(max(m.max(), -int(m.min()))) if m.size else 0
        if w.dim * (w.n * largest + most_sum) ** 2 <= MOST:
            return ((w.n * m - np.array(w.sums)) ** 2).sum(1).tolist()
        exact = [sum((w.n * v - s) ** 2 for v, s in zip(row, w.sums, strict=True)) for row in m.tolist()]
        return [d if d <= MOST else None for d in exact]

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("x"), w.dim)
            white = (m - mean) @ scaled
            rows = np.repeat(np.arange(len(m)), k)
            part = np.tile(np.arange(k), len(m))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").cast(pa.int64()).take(pa.array(rows)), pa.array(part + 1, pa.int32()), pa.array(np.full(len(rows), w.n)),
                    pa.array(deviations(m), pa.int64()).take(pa.array(rows)), pa.array(white.ravel()), pa.array((w.values / w.trace)[part]), pa.array(np.full(len(rows), w.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(x.where(F.size("x") == w.dim), run, kind)


def whitened_embeddings(vectors: DataFrame, components: int = 4) -> DataFrame:
    """Whitened coordinates of ``vectors`` (vec_id, embedding); see ``fit`` and ``whiten``.

    Null vectors and those with null or non-finite entries are dropped; a row without an id
    stays, with a null id.  Repeated rows each have their rows; copies of a vector count once in
    the fit.  An empty table, or vectors that are all equal, give no rows.  Other columns are ignored.
    """
    x = integer_vectors(vectors)
    return whiten(x, fit(x, components))
