"""Rows that once broke an operator: empty vectors, scores beyond a long, equal rows, absent ids and texts."""

import numpy as np
from pyspark.sql import functions as F

from dialoom.llm import minhash, packing, samples, suffixdedup, topk
from dialoom.llm.queries import tokenizer_path


def test_empty_and_mixed_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [] if i % 3 == 0 else rng.standard_normal(4 if i % 3 == 1 else 7).tolist()) for i in range(0, 300, 10)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    want = []
    for q, x in rows:
        if q % 50 == 0:
            dots = [(-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(x, y, strict=True)), c) for c, y in rows if c != q and len(y) == len(x)]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(dots)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e100, 1.0]), (1, [1e150, 1.0]), (2, [1e160, 0.0]), (3, [-1e190, 5.0]), (4, [0.0, 1.0]), (5, [1e300, 0.0]), (6, [1.7e308, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 6, 2, 1, 4, 3]  # the first two are beyond doubles too, so by id
    assert [r.score for r in got] == [None, None, None, None, 65536, None]


def test_spans_of_equal_rows_stand_once(spark):
    rng = np.random.default_rng(6)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 3000))
    one = suffixdedup.repeated_spans(spark.createDataFrame([(1, text)] * 2 + [(2, "b" * 10)], "doc_id long, text string"))[1]
    many = suffixdedup.repeated_spans(spark.createDataFrame([(1, text)] * 400 + [(2, "b" * 10)], "doc_id long, text string"))[1]
    size = lambda df: df.select(F.max(F.size("spans"))).first()[0]
    assert size(many) == size(one)
    out = suffixdedup.remove_repeats(spark.createDataFrame([(1, text)] * 400, "doc_id long, text string")).distinct().collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in out] == [(3000, 3000, 1)]


def test_rows_without_id_are_not_ranked_together(spark):
    rows = [(None, f"text number {i} " * 9) for i in range(300)] + [(1, "first text of one"), (1, "another text of one"), (2, None)]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("doc_id is null").count() == 300
    assert sorted(tuple(r) for r in out.where("doc_id is not null").collect()) == [(1, "another text of one"), (2, None)]


def test_salts_spread_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 10)
    rows = [(None, f"w{i} and {i * 7}") for i in range(200)] + [(3, "same")] * 40
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"))
    pieces = sorted((r.sequence_id, r.offset, r.length) for r in out.collect())
    assert len(pieces) == 240
    at = {}
    for seq, offset, length in pieces:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length


def test_samples_take_usable_texts(spark):
    docs = [(i, "x" * 5000) for i in range(200)] + [(i, f"short {i}") for i in range(200, 205)] + [(205, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(206)] + [(999, 1), (None, 1), (201, None)], "doc_id long, label int")
    got = samples.labelled_texts(spark.createDataFrame(docs, "doc_id long, text string"), labels, 10, 100)
    assert sorted(got.column("text").to_pylist()) == [f"short {i}" for i in range(200, 205)]


def test_blocks_that_cannot_reach_a_floor_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 25)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((16, 32)) * 4
    x = centres[rng.integers(0, 16, 4000)] + 0.05 * rng.standard_normal((4000, 32))
    met = []
    pairs = topk._pairs
    monkeypatch.setattr(topk, "_pairs", lambda q, c: met.append((pairs(q, c).count(), q.count() * c.count())) or pairs(q, c))
    got = topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=10).collect()
    ints = np.floor(256 * x).astype(np.int64)
    want = []
    for q in range(0, 4000, 10):
        found = ints @ ints[q]
        want += [(q, n + 1, j, s) for n, (s, j) in enumerate([(-s, j) for s, j in sorted((-s, j) for j, s in enumerate(found.tolist()) if j != q)[:5]])]
    assert sorted(map(tuple, got)) == want
    assert met[0][0] < met[0][1] / 2  # most pairs of blocks never meet


def test_bounds_of_blocks_hold():
    rng = np.random.default_rng(9)
    for dim in (1, 5, 16, 40):
        q, c = rng.standard_normal((30, dim)), rng.standard_normal((20, dim)) + 1
        bound = topk.bounds(topk.statistics(q, topk.LEVELS[-1]), topk.summary(c)[None, :])
        assert (bound[:, 0] >= (q @ c.T).max(1) - 1e-9).all()
