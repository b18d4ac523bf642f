"""Toxicity: a bidirectional gated recurrent network with attention, in numpy.

Texts are read as words (runs of letters, digits and bytes over 127, A-Z in lower case).  A
word's input is its own hashed vector plus the mean of the vectors of its character trigrams.
All overlapping windows of ``WINDOW`` words are scored, one from each word on: two gated
recurrent passes read a block of words once, attention pools the states of each window in it,
and the largest score of a text's windows is the text's.  A text of fewer words is one window.
Labels are of whole texts, so each round of training takes, of a text, the window that scores
highest at that point, and for the others a second one at random.  How far a word tells toxic
texts from others chooses the windows of the first rounds and is where its vector starts, so
that few toxic texts suffice to find the way.

The sample for training is bounded: ``PER_LABEL`` texts of at most ``MOST_BYTES`` bytes for
each label.  The inputs of the recurrent steps are computed once for each distinct word of a
slice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .hashed import calibrate, sigmoid
from .samples import labelled_texts
from .store import map_batches

WINDOW = 32  # a power of two
#: Windows that start in one block; a block holds all their words.
STARTS = 32
BLOCK = STARTS + WINDOW - 1
DIM, HIDDEN, ATT = 12, 8, 8
CHAR_BITS = 11
PER_LABEL = 700
MOST_BYTES = 8_192
EPOCHS = 8
#: Words with a vector of their own: those of at least MIN_TEXTS texts of the sample, the most frequent first.
MIN_TEXTS, MOST_WORDS = 5, 8_192
BATCH = 2048
#: Weight of a word's deviation (see ``_telling``) in its first vector, and rounds that choose windows by it.
TOLD, TOLD_EPOCHS = 0.4, 4

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Slice:
    """The words of some texts: distinct ones, and blocks of indices to them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        start, end, row = tk.words(data, at, SEPARATOR)
        low = tk.LOWER[data]
        hashes = tk.span_hash(tk.prefix_hash(low), start, end)
        self.words, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        size = e - s  # trigrams of a word with a blank before and behind it
        cut = np.cumsum(size) - size
        p = np.repeat(s - cut, size) + np.arange(int(size.sum()))
        left = np.where(p > np.repeat(s, size), low[np.maximum(p - 1, 0)], 32) if len(p) else np.zeros(0, int)
        right = np.where(p + 1 < np.repeat(e, size), low[np.minimum(p + 1, len(low) - 1)], 32) if len(p) else np.zeros(0, int)
        packed = left.astype(np.uint32) | low[p].astype(np.uint32) << np.uint32(8) | right.astype(np.uint32) << np.uint32(16)
        self.tri = ((packed * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
        self.tri_cut, self.tri_size = cut, size
        count = np.bincount(row, minlength=n)
        first_word = np.cumsum(count) - count
        starts = np.where(count > 0, np.maximum(1, count - WINDOW + 1), 0)
        per = -(-starts // STARTS)
        self.owner = np.repeat(np.arange(n), per)
        behind = (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * STARTS
        self.starts = np.minimum(starts[self.owner] - behind, STARTS)  # windows of each block
        pos = (first_word[self.owner] + behind)[:, None] + np.arange(BLOCK)
        inside = pos < (first_word + count)[self.owner][:, None]
        blank = len(self.words)  # an index behind the last word
        self.index = np.where(inside, np.append(word.astype(np.int32), 0)[np.minimum(pos, len(word))], blank).astype(np.int32)
        self.n = n


def rows_of(p: dict, s: Slice) -> np.ndarray:
    """Row in the table of word vectors of each distinct word; the last row is of all others."""
    vocab = p["vocab"]
    at = np.minimum(np.searchsorted(vocab, s.words), max(0, len(vocab) - 1))
    return np.where(vocab[at] == s.words, at, len(vocab)) if len(vocab) else np.zeros(len(s.words), np.int64)


def initial(vocab: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def f(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"vocab": vocab, "word": f(len(vocab) + 1, DIM, scale=0.05), "char": f(1 << CHAR_BITS, DIM, scale=0.1)}
    for d in "fb":
        p |= {f"w{d}": f(DIM, 3 * HIDDEN, scale=DIM**-0.5), f"u{d}": f(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"att": f(2 * HIDDEN, ATT, scale=0.3), "v": f(ATT, scale=0.5), "out": f(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1.0, np.float32)}
    p["calibration"] = np.array([1.0, 0.0])
    return p


def word_inputs(p: dict, s: Slice) -> np.ndarray:
    """Vectors of the distinct words, and of the blank."""
    x = np.zeros((len(s.words) + 1, DIM), np.float32)
    if len(s.words):
        x[:-1] = p["word"][rows_of(p, s)] + np.add.reduceat(p["char"][s.tri], s.tri_cut, axis=0) / s.tri_size[:, None]
    return x


def _sig(x):
    return 1 / (1 + np.exp(-x))


def recurrent(p: dict, x: np.ndarray, index: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
    """States of the words of blocks, with what ``backward`` needs if ``keep``."""
    n, h, blank = len(index), HIDDEN, len(x) - 1
    mask = index != blank
    size = index.shape[1]
    states, saved = np.zeros((size, n, 2 * h), np.float32), {}
    for d in "fb":
        pre_all, u = x @ p[f"w{d}"] + p[f"c{d}"], p[f"u{d}"]
        state = np.zeros((n, h), np.float32)
        for t in range(size) if d == "f" else range(size - 1, -1, -1):
            pre, hu = pre_all[index[:, t]], state @ u
            g = _sig(pre[:, : 2 * h] + hu[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            new = np.tanh(pre[:, 2 * h :] + r * hu[:, 2 * h :])
            m = mask[:, t, None]
            nxt = np.where(m, new + z * (state - new), state)
            if keep:
                saved[d, t] = (state, z, r, new, hu[:, 2 * h :], m)
            state = nxt
            (states[t, :, :h] if d == "f" else states[t, :, h:])[...] = state
    return states, saved


def forward(p: dict, x: np.ndarray, index: np.ndarray, begin: np.ndarray, keep: bool):
    """Logits of one window of each block, with what ``backward`` needs if ``keep``."""
    states, saved = recurrent(p, x, index, keep)
    t = np.arange(index.shape[1])
    mask = (index != len(x) - 1) & (t >= begin[:, None]) & (t < begin[:, None] + WINDOW)
    a = np.tanh(states @ p["att"])
    e = np.where(mask.T, a @ p["v"], -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = (w[:, :, None] * states).sum(0)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (states, a, w, pooled, saved)


def backward(p: dict, x: np.ndarray, index: np.ndarray, kept, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters behind the word vectors, and of the word vectors."""
    states, a, w, pooled, saved = kept
    h = HIDDEN
    g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()])}
    d_pool = d_logit[:, None] * p["out"]
    d_w = (states * d_pool).sum(2)
    d_e = w * (d_w - (w * d_w).sum(0))
    g["v"] = np.einsum("tn,tna->a", d_e, a)
    d_a = d_e[:, :, None] * p["v"] * (1 - a * a)
    g["att"] = np.einsum("tnh,tna->ha", states, d_a)
    d_states = w[:, :, None] * d_pool + d_a @ p["att"].T
    d_x = np.zeros_like(x)
    for d in "fb":
        u, carry = p[f"u{d}"], np.zeros((len(index), h), np.float32)
        du, d_pre_all = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
        for t in range(index.shape[1] - 1, -1, -1) if d == "f" else range(index.shape[1]):
            state, z, r, new, hn, m = saved[d, t]
            dh = carry + (d_states[t, :, :h] if d == "f" else d_states[t, :, h:])
            live = np.where(m, dh, 0)
            d_new = live * (1 - z) * (1 - new * new)
            d_z = live * (state - new) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_pre = np.concatenate([d_z, d_r, d_new], 1)
            d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
            du += state.T @ d_hu
            carry = np.where(m, dh * z, dh) + d_hu @ u.T
            np.add.at(d_pre_all, index[:, t], d_pre)
        g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = du, d_pre_all.sum(0), x.T @ d_pre_all
        d_x += d_pre_all @ p[f"w{d}"].T
    return g, d_x


def of_windows(rows: np.ndarray, combine: Callable) -> np.ndarray:
    """``WINDOW`` rows combined from each row on that has so many."""
    size = 1
    while size < WINDOW:
        rows = combine(rows[:-size], rows[size:])
        size *= 2
    return rows


def window_scores(p: dict, s: Slice) -> np.ndarray:
    """Logits of all windows: a row for each block, with the least value behind its last window."""
    x = word_inputs(p, s)
    out = np.full((len(s.index), STARTS), -np.inf, np.float32)
    for i in range(0, len(out), BATCH):
        index = s.index[i : i + BATCH]
        states, _ = recurrent(p, x, index, False)
        e = np.where(index.T != len(x) - 1, np.exp(np.tanh(states @ p["att"]) @ p["v"]), 0)
        weight, drawn = of_windows(e, np.add), of_windows(e * (states @ p["out"]), np.add)
        valid = np.arange(STARTS) < s.starts[i : i + BATCH, None]
        out[i : i + BATCH][valid] = drawn.T[valid] / weight.T[valid] + p["bias"][0]
    return out


def text_scores(p: dict, s: Slice, windows: np.ndarray) -> np.ndarray:
    """The largest logit of each text's windows; that of a text without words is the least."""
    out = np.full(s.n, -20.0)
    np.maximum.at(out, s.owner, windows.max(1))
    return out


def _telling(s: Slice, y: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How far each distinct word tells toxic texts from others, in deviations of its count of texts; least for the blank."""
    n = len(s.words) + 1
    seen = np.zeros((2, n))
    pairs = np.unique(np.repeat(s.owner, BLOCK).astype(np.int64) * n + s.index.ravel())
    pairs = pairs[~held[pairs // n]]
    np.add.at(seen, (y[pairs // n], pairs % n), 1)
    totals, texts = np.bincount(y[~held], minlength=2), seen.sum(0)
    share = totals[1] / max(1, totals.sum())
    told = (seen[1] - share * texts) / np.sqrt(share * (1 - share) * texts + 1)
    told[-1] = told.min()
    return told


def fit(column: pa.Array, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters from a bounded number of labelled texts; a fifth of them only calibrates."""
    raw, at = tk.buffers(column)
    s = Slice(raw[at[0] : at[-1]], at - at[0])
    held = np.arange(s.n) % 5 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(s.n, bool)
    learn = ~held[s.owner]
    use = np.flatnonzero((np.arange(STARTS) < s.starts[:, None]) & learn[:, None])  # windows, by block and start
    owner = s.owner[use // STARTS]
    blank = len(s.words)
    pairs = np.unique(np.repeat(s.owner[learn], BLOCK).astype(np.int64) * (blank + 1) + s.index[learn].ravel())
    texts = np.bincount(pairs % (blank + 1), minlength=blank + 1)[:blank]
    common = np.argsort(-texts, kind="stable")[:MOST_WORDS]
    common = np.sort(common[texts[common] >= MIN_TEXTS])  # distinct words are sorted by hash
    p, rng = initial(s.words[common]), np.random.default_rng(seed)
    row_of = rows_of(p, s)
    told = _telling(s, y, held)
    own = row_of < len(common)
    p["word"][row_of[own], 0] += TOLD * np.clip(told[:-1][own], -5, 5)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("vocab", "calibration")}
    share = 0.5 / np.maximum(1, np.bincount(y, minlength=2))
    rate, step = 0.01, 0
    for epoch in range(epochs):
        score = (of_windows(told[s.index].T, np.maximum).T if epoch < TOLD_EPOCHS else window_scores(p, s)).ravel()[use]
        order = np.lexsort((rng.random(len(use)), -score, owner))  # ties by chance, so that no place in a window is favoured
        top = order[np.unique(owner[order], return_index=True)[1]]
        other = rng.permutation(len(use))
        other = other[y[owner[other]] == 0][: 2 * len(top)]
        chosen = use[rng.permutation(np.unique(np.concatenate([top, other])))]
        for i in range(0, len(chosen), 128):
            rows, begin = np.divmod(chosen[i : i + 128], STARTS)
            used, local = np.unique(s.index[rows], return_inverse=True)
            if used[-1] != blank:
                used = np.append(used, blank)
            x = word_inputs(p, s)[used]
            local = local.reshape(len(rows), BLOCK)
            logit, kept = forward(p, x, local, begin, True)
            t = y[s.owner[rows]]
            weight = share[t] / share[t].mean()
            d = ((sigmoid(logit) - t) * weight / len(rows)).astype(np.float32)
            g, d_x = backward(p, x, local, kept, d)
            used, d_x = used[:-1], d_x[:-1]
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], row_of[used], d_x)
            size = s.tri_size[used]
            pos = np.repeat(s.tri_cut[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            np.add.at(g["char"], s.tri[pos], np.repeat(d_x / size[:, None], size, axis=0))
            step += 1
            for k, (m1, m2) in moments.items():
                grad = np.asarray(g[k], np.float32)
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        rate *= 0.85
    if held.any():
        found = text_scores(p, s, window_scores(p, s))[held]
        a, b = calibrate(found, y[held])
        p["calibration"] = np.array([a, b])
    return p


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES) -> dict[str, np.ndarray]:
    """Parameters from ``labels`` (doc_id, toxic); without both labels no text is toxic."""
    t = labelled_texts(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("label")), per_label, most_bytes)
    y = np.array(t.column("label").to_pylist(), dtype=np.int64)
    if len(np.unique(y)) < 2:
        p = initial(np.zeros(0, np.uint64))
        p["out"][:], p["bias"][:] = 0, -4
        return p
    return fit(t.column("text").combine_chunks(), (y > 0).astype(np.int64))


def _score(p: dict) -> Callable:
    def run(batches):
        for batch in batches:
            parts = [np.zeros(0)]
            for _lo, _hi, data, at in tk.slices(batch.column("text")):
                s = Slice(data, at)
                a, b = p["calibration"]
                parts.append(sigmoid(a * text_scores(p, s, window_scores(p, s)) + b))
            score = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``.

    Null, empty and wordless texts have a score near 0.  Equal texts have equal scores; null
    ids stay; other columns are not read.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(src, _score(params), f"doc_id {dict(src.dtypes)['doc_id']}, score double, predicted int")
