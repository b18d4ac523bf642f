"""The linear models: fitted without a dense matrix, as with one."""

import tracemalloc

import numpy as np
import pyarrow as pa
from test_operators import prose

from dialoom.llm import hashed, quality


def test_quality_fit_makes_no_dense_matrix(spark):
    n = 2 * quality.PER_LABEL
    docs = spark.createDataFrame([(i, prose(40 + i % 50, i, 10**4) + " bad words" * (i % 2)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < n * quality.GRAMS.size  # a quarter of the features as 32-bit numbers
    p = model.probability(pa.array([prose(60, 10**6, 10**4), prose(60, 10**6, 10**4) + " bad words"]))
    assert p[0] > 0.5 > p[1]


def test_sparse_fit_equals_dense():
    texts = pa.array(["", None, "é", "a", *(prose(3 + i, i, 50) for i in range(60))])
    y = (np.arange(len(texts)) % 3 == 0).astype(float)
    g = hashed.Grams(chars=(1, 3, 4), words=(1, 2), bits=8)
    sparse = hashed.rows(texts, g)
    for loss in ("logistic", "hinge"):
        (w, b), (dw, db) = hashed.fit_linear(sparse, y, loss), hashed.fit_linear(hashed.matrix(texts, g), y, loss)
        assert np.allclose(w, dw, atol=1e-3 * np.abs(dw).max()) and abs(b - db) < 1e-3 * max(1, abs(db))
