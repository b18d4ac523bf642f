"""Whitened embeddings against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import whitening
from dialoom.llm.queries import op13_chebyshev_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, "x") for i, e in rows], SCHEMA)


def check(rows, out, k=4):
    """``rows`` as (vec_id, list or None), ``out`` the operator's rows."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in e]) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    v = np.cov(fit.T, bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    assert len(out) == len(good) * k
    sums = [sum(int(a[j]) for a in fit) for j in range(fit.shape[1])]
    white, want = {}, {}
    for r in out:
        assert r.n == len(fit) and abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9
        white.setdefault((r.vec_id, r.component), []).append((r.whitened, r.deviation))
    for i, x in good:
        p = (np.array(x) - fit.mean(0)) @ q / np.sqrt(e)
        for c in range(k):
            want.setdefault((i, c + 1), []).append((p[c], sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))))
    assert white.keys() == want.keys()
    for c in range(1, k + 1):
        pairs = [(a, b) for key in want if key[1] == c for a, b in zip(sorted(white[key], key=lambda t: t[1]), sorted(want[key], key=lambda t: t[1]), strict=True)]
        sign = np.sign(max(pairs, key=lambda t: abs(t[1][0]))[1][0] * max(pairs, key=lambda t: abs(t[1][0]))[0][0])
        for (w, d), (w2, d2) in pairs:
            assert d == d2 and abs(sign * w - w2) < 1e-8


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 12)) * np.linspace(1, 3, 12)
    rows = [(i, e.astype(np.float32).tolist()) for i, e in enumerate(base)]
    rows += [(500 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1])] * 3 + [(None, rows[5][1])]
    bad = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, [])]
    out = whitening.whitened_embeddings(frame(spark, rows + bad).repartition(5)).collect()
    check(rows, out)


def test_many_dimensions_and_close_eigenvalues(spark):
    """More dimensions than the subspace is wide, so the filter has to work."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 96))
    base[:, 0] *= 1.6
    base[:, 1] *= 1.59
    rows = [(i, e.astype(np.float32).tolist()) for i, e in enumerate(base)]
    check(rows, whitening.whitened_embeddings(frame(spark, rows)).collect())


def test_few_and_equal_vectors(spark):
    empty = whitening.whitened_embeddings(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened_embeddings(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitened_embeddings(frame(spark, [(1, []), (2, None)])).collect() == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # rank one: one component
    check(line, whitening.whitened_embeddings(frame(spark, line)).collect(), k=1)
    mixed = [(i, [float(i), float(i * i)]) for i in range(9)]
    check(mixed, whitening.whitened_embeddings(frame(spark, mixed + [(50, [1.0, 2.0, 3.0])])).collect(), k=2)


def test_large_entries_are_exact_or_null(spark):
    rows = [(0, [2e6, 0.0]), (1, [-2e6, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 5e5])]
    check(rows, whitening.whitened_embeddings(frame(spark, rows)).collect(), k=2)
    out = whitening.whitened_embeddings(frame(spark, [(0, [1e12, 0.0]), (1, [-1e12, 1.0])])).collect()
    assert [r.deviation for r in out] == [None, None]


def test_filter_damps_below_the_cut():
    values = np.linspace(0, 10, 40)
    q = np.eye(40)
    y = np.diag(whitening.chebyshev(lambda m: values[:, None] * m, q, values[:, None] * q, 9, 0.0, 7.0, 10.0))
    assert abs(y[values <= 7]).max() < 0.01 * y[-1] and (np.diff(y[values > 7.2]) > 0).all()


@pytest.mark.parametrize("dim,k", [(60, 4), (200, 3), (5, 4), (3, 3)])
def test_leading_pairs(dim, k):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((dim, dim))
    v = a @ a.T
    values, vectors, _ = whitening.leading_pairs(lambda m: v @ m, dim, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.allclose(values, want, rtol=1e-12) and np.abs(v @ vectors - vectors * values).max() < 1e-9 * want[0]


def test_partial_sums_over_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, e.astype(np.float32).tolist()) for i, e in enumerate(rng.standard_normal((90, 6)))]
    check(rows, whitening.whitened_embeddings(frame(spark, rows).repartition(7)).collect())


def test_query_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding")).collect()]
    check(rows, op13_chebyshev_whitening(spark, d).collect())
