"""Language identification in two steps: the family, then pairs of languages within it.

A linear classifier picks the language family; one-versus-one linear support vector machines
separate the languages of that family.  All are linear in hashed character n-grams, so a
whole text is scored in one pass for all of them.  The sample for fitting is bounded:
``PER_LANG`` texts of at most ``MOST_BYTES`` bytes for each language.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .samples import labelled_texts
from .store import map_batches

PER_LANG = 400
MOST_BYTES = 16_384
UNKNOWN = "und"
GRAMS = hashed.Grams(chars=(1, 2, 3, 4), bits=12, lower=True)
#: Families of languages (fixed values); a language that isn't listed is of the family "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk"),
    "cjk": ("zh", "ja", "ko"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "other")


@dataclass(frozen=True)
class Model:
    families: list[str]
    langs: list[list[str]]
    weights: np.ndarray  # a column for each family, then for each pair within a family
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text."""
        n = len(column)
        if not self.families:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        s = hashed.scores(column, GRAMS, self.weights) + self.bias
        k = len(self.families)
        p = hashed.sigmoid(4 * s[:, :k])
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lang, score, at = np.empty(n, object), np.zeros(n), k
        for f, langs in enumerate(self.langs):
            votes = np.zeros((n, len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                q = hashed.sigmoid(4 * s[:, at])
                votes[:, i] += q
                votes[:, j] += 1 - q
                at += 1
            own = np.flatnonzero(best == f)
            top = votes[own].argmax(1)
            lang[own] = np.array(langs, object)[top]
            share = votes[own, top] / (len(langs) - 1) if len(langs) > 1 else 1.0
            score[own] = p[own, f] * share
        return lang, score


def train(docs: DataFrame, per_lang: int = PER_LANG, most_bytes: int = MOST_BYTES) -> Model:
    """The model of the texts and non-null languages of ``docs``."""
    labels = docs.select("doc_id", F.col("lang").cast("string").alias("label"))
    t = labelled_texts(docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)), labels, per_lang, most_bytes)
    y = np.array(t.column("label").to_pylist(), dtype=object)
    if not len(y):
        return Model([], [], np.zeros((GRAMS.size, 1)), np.zeros(1))
    x = hashed.matrix(t.column("text").combine_chunks(), GRAMS)
    fam = np.array([family(v) for v in y], object)
    families = sorted(set(fam))
    langs = [sorted(set(y[fam == f])) for f in families]
    fitted = [hashed.fit_linear(x, (fam == f).astype(float), "hinge") if len(families) > 1 else (np.zeros(GRAMS.size), 1.0) for f in families]
    for of in langs:
        for a, b in combinations(of, 2):
            rows = (y == a) | (y == b)
            fitted.append(hashed.fit_linear(x[rows], (y[rows] == a).astype(float), "hinge"))
    return Model(families, langs, np.stack([w for w, _ in fitted], 1), np.array([b for _, b in fitted]))


def _predict(model: Model) -> Callable:
    def run(batches):
        for batch in batches:
            lang, score = model.predict(batch.column("text"))
            none = ~np.array(batch.column("letter").to_pylist(), bool)
            lang[none], score[none] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0.  Equal texts have equal
    results; null ids stay; other columns are not read.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("letter", letter)
    return map_batches(src, _predict(model), f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double")
