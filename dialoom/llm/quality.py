"""Quality rules: counting rules and a calibrated logistic regression over hashed n-grams.

The rules are counted on whole texts in numpy over Arrow batches.  The model sees hashed
word and character n-grams, is fitted on a bounded sample of labelled rows (``PER_LABEL``
for each label, texts of at most ``MOST_BYTES`` bytes), calibrated on a fifth of it that it
wasn't fitted on, and its probability is held against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from . import textkit as tk
from .samples import labelled_texts
from .store import map_batches

PER_LABEL = 600
MOST_BYTES = 16_384
THRESHOLD = 0.5
MIN_WORDS = 20
REPEAT_PERCENT = 30
RUN = 8
GRAMS = hashed.Grams(chars=(2, 3, 4), words=(1, 2), bits=12)

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, column: pa.Array) -> np.ndarray:
        s = hashed.scores(column, GRAMS, self.weights[:, None])[:, 0] + self.bias
        return hashed.sigmoid(self.slope * s + self.shift)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES) -> Model:
    """The model of ``labels`` (doc_id, quality); without both labels every text passes."""
    t = labelled_texts(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")), per_label, most_bytes)
    y = np.array(t.column("label").to_pylist(), dtype=float)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(GRAMS.size), 0.0, 0.0, 1.0)
    held = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    judged = held if held.any() else np.ones(len(y), bool)
    text = t.column("text").combine_chunks()
    w, b = hashed.fit_linear(hashed.rows(text.filter(pa.array(~held)), GRAMS), y[~held], "logistic")
    found = hashed.scores(text.filter(pa.array(judged)), GRAMS, w[:, None])[:, 0] + b
    return Model(w, b, *hashed.calibrate(found, y[judged]))


def counts(column: pa.Array) -> np.ndarray:
    """Rows (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the texts."""
    parts = [np.zeros((0, 5), np.int64)]
    for lo, hi, data, at in tk.slices(column):
        n = hi - lo
        out = np.zeros((n, 5), np.int64)
        start, end, row = tk.words(data, at)
        out[:, 0] = np.bincount(row, minlength=n)
        head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        out[:, 1] = np.bincount(row, head[end] - head[start], minlength=n)
        sign = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        out[:, 2] = sign[at[1:]] - sign[at[:-1]]
        prefix = tk.prefix_hash(data)
        # lines with a word: they begin at a text's start or behind a line feed
        feeds = np.flatnonzero(data == 10)
        text = np.flatnonzero(np.diff(at) > 0)
        begin = np.unique(np.concatenate([at[:-1][text], feeds + 1]))
        begin = begin[begin < len(data)]
        owner = np.searchsorted(at, begin, "right") - 1
        stop = np.minimum(at[owner + 1], np.append(feeds, len(data))[np.searchsorted(feeds, begin)])
        used = np.searchsorted(start, stop) > np.searchsorted(start, begin)
        begin, stop, owner = begin[used], stop[used], owner[used]
        out[:, 3] = np.bincount(owner, minlength=n) - _distinct(owner, tk.span_hash(prefix, begin, stop), n)
        pos, runs = tk.windows(tk.span_hash(prefix, start, end), row, n, RUN, short=False)
        twice = _repeated(row[pos], runs)
        cover = np.zeros(len(start) + 1, np.int64)
        np.add.at(cover, pos[twice], 1)
        np.add.at(cover, pos[twice] + RUN, -1)
        out[:, 4] = np.bincount(row, np.cumsum(cover[:-1]) > 0, minlength=n)
        parts.append(out)
    return np.concatenate(parts)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n)


def _repeated(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each of the values occurs elsewhere in its text."""
    out = np.zeros(len(h), bool)
    # equal values mostly lie in one text, so a sort by value alone finds the few to look at
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    some = np.zeros(len(h), bool)
    some[1:] |= same
    some[:-1] |= same
    at = np.sort(order[some])
    if len(at):
        order = at[np.lexsort((h[at], owner[at]))]
        o, v = owner[order], h[order]
        same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
        hit = np.zeros(len(at), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[order[hit]] = True
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def _score(model: Model, threshold: float, keys: list[str]) -> Callable:
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            c = counts(text)
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > REPEAT_PERCENT * c[:, 0])
            p = model.probability(text)
            cols = [*(pa.array(c[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            names = [x.split()[0] for x in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], names=[*keys, *names])

    return run


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, base_failed, kept, probability) for each row of ``docs``.

    A null or empty text has no words and fails the rules.  Equal rows are judged alike;
    null ids stay; other columns are not read.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(src, _score(model, threshold, ["doc_id"]), f"doc_id {dict(src.dtypes)['doc_id']}, {COLUMNS}")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""

    def run(batches):
        score = _score(model, threshold, [])
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            verdict = next(score(iter([pa.RecordBatch.from_arrays([text], names=["text"])])))
            yield batch.filter(verdict.column("kept"))

    return map_batches(docs, run, docs.schema)
