"""Hashed word and character n-grams of whole texts, and linear models over them.

A text's features are its n-gram counts over the number of its n-grams.  A linear score is
then a mean of table entries over all positions, which is how texts of any length are
scored, without building vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import textkit as tk

#: Values of sparse rows that are multiplied at once.
RUN = 1 << 17


@dataclass(frozen=True)
class Grams:
    """Lengths of byte n-grams (at most 4) and word n-grams, and log2 of the table's size."""

    chars: tuple[int, ...] = (2, 3, 4)
    words: tuple[int, ...] = ()
    bits: int = 13
    lower: bool = False

    @property
    def blocks(self) -> int:
        return len(self.chars) + len(self.words)

    @property
    def size(self) -> int:
        return self.blocks << self.bits


def _positions(data: np.ndarray, at: np.ndarray, g: Grams):
    """For each block of features: (index in its table of each n-gram, first n-gram of each text)."""
    shift = np.uint32(32 - g.bits)
    data = tk.LOWER[data] if g.lower else data
    wide = np.zeros(len(data) + 3, np.uint32)
    wide[: len(data)] = data
    packed = wide[: len(data)].copy()
    for n in range(1, 5):
        if n > 1:
            packed |= wide[n - 1 : n - 1 + len(data)] << np.uint32(8 * (n - 1))
        if n in g.chars:
            index = (packed * np.uint32(2654435761)) >> shift
            # n-grams that reach over the end of their text go to no bucket
            first = np.maximum(at[1:] - (n - 1), at[:-1])
            cut = np.zeros(len(data) + 1, np.int32)
            np.add.at(cut, first, 1)
            np.add.at(cut, at[1:], -1)
            keep = np.cumsum(cut[:-1]) == 0
            yield index[keep], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(at) - (n - 1)))])
    if g.words:
        start, end, row = tk.words(data, at)
        h = tk.word_hashes(data, start, end)
        for k in g.words:
            pos, grams = tk.windows(h, row, len(at) - 1, k, short=False)
            yield (grams >> np.uint64(64 - g.bits)).astype(np.uint32), np.searchsorted(row[pos], np.arange(len(at)))


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between cuts."""
    out = np.zeros((len(cut) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(cut) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, cut[full], axis=0, dtype=np.float64)
    return out


@dataclass(frozen=True)
class Rows:
    """Features of texts without their zeros: the columns and values of row i lie from cut[i] to cut[i + 1]."""

    cut: np.ndarray
    index: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.cut) - 1

    def runs(self):
        """(rows, columns, values) of some rows at a time, about ``RUN`` values."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.cut, self.cut[lo] + RUN, "right")) - 1)
            at = slice(self.cut[lo], self.cut[hi])
            yield np.repeat(np.arange(lo, hi), np.diff(self.cut[lo : hi + 1])), self.index[at], self.value[at]
            lo = hi

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for row, index, value in self.runs():
            if len(row):
                out[row[0] : row[-1] + 1] += np.bincount(row - row[0], w[index] * value)
        return out

    def sums(self, u: np.ndarray, power: int = 1) -> np.ndarray:
        """Sums over rows of u times the features (to a power)."""
        out = np.zeros(self.width)
        for row, index, value in self.runs():
            out += np.bincount(index, u[row] * value**power, minlength=self.width)
        return out

    def dense(self) -> np.ndarray:
        x = np.zeros((len(self), self.width), np.float32)
        for row, index, value in self.runs():
            x[row, index] = value
        return x


class Scaled:
    """(rows - mean) / scale for products from both sides; the centred matrix is never made."""

    __array_ufunc__ = None  # arrays leave their products to this class

    def __init__(self, rows: Rows) -> None:
        one, n = np.ones(len(rows)), max(1, len(rows))
        self.rows, self.mean = rows, rows.sums(one) / n
        var = np.maximum(0, rows.sums(one, 2) / n - self.mean**2)
        dev = np.sqrt(var) + 1e-4
        self.scale = dev * (np.sqrt((var / dev**2).sum()) + 1e-9)
        self.shape = (len(rows), rows.width)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        w = w / self.scale
        return self.rows.times(w) - self.mean @ w

    def __rmatmul__(self, u: np.ndarray) -> np.ndarray:
        return (self.rows.sums(u) - u.sum() * self.mean) / self.scale


def rows(column: pa.Array, g: Grams) -> Rows:
    """Features of a bounded number of texts."""
    size, index, value = [0], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for lo, hi, data, at in tk.slices(column):
        found = list(_positions(data, at, g))
        for i in range(hi - lo):
            n = 0
            for b, (grams, cut) in enumerate(found):
                own = grams[cut[i] : cut[i + 1]]
                if len(own):
                    count = np.bincount(own)
                    some = np.flatnonzero(count)
                    index.append((some + (b << g.bits)).astype(np.int32))
                    value.append((count[some] / len(own)).astype(np.float32))
                    n += len(some)
            size.append(n)
    return Rows(np.cumsum(size), np.concatenate(index), np.concatenate(value), g.size)


def matrix(column: pa.Array, g: Grams) -> np.ndarray:
    """The same, dense."""
    return rows(column, g).dense()


def scores(column: pa.Array, g: Grams, weights: np.ndarray) -> np.ndarray:
    """features @ weights of each text; weights has a row for each feature."""
    w = weights.astype(np.float32).reshape(g.blocks, 1 << g.bits, -1)
    parts = [np.zeros((0, w.shape[2]))]
    for lo, hi, data, at in tk.slices(column):
        out = np.zeros((hi - lo, w.shape[2]))
        for b, (index, cut) in enumerate(_positions(data, at, g)):
            out += _sums(w[b][index], cut) / np.maximum(1, np.diff(cut))[:, None]
        parts.append(out)
    return np.concatenate(parts)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_linear(x: np.ndarray | Rows, y: np.ndarray, loss: str, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """(weights, bias) for y in {0, 1}, classes weighing alike.

    ``loss``: "logistic", or "hinge" for a support vector machine (squared hinge).  Features
    are scaled by their deviations; the scales are part of the weights that are returned.
    Of ``Rows`` no dense matrix is made; a dense one is copied once.
    """
    if isinstance(x, Rows):
        z = Scaled(x)
        mean, scale = z.mean, z.scale
    else:
        mean, dev = x.mean(0), x.std(0, dtype=np.float32) + np.float32(1e-4)
        z = x - mean  # the one copy
        z /= dev
        norm = np.float32(np.sqrt(np.einsum("ij,ij->", z, z) / max(1, len(z))) + 1e-9)
        z /= norm
        scale = dev * np.float64(norm)
    t = np.where(y > 0, 1.0, -1.0)
    n1 = max(1, int((y > 0).sum()))
    share = np.where(y > 0, 0.5 / n1, 0.5 / max(1, len(y) - n1))
    w, b, vw, vb = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    for i in range(rounds):
        m = t * (z @ (w + 0.9 * vw).astype(np.float32) + b + 0.9 * vb)
        slope = -t * share * (sigmoid(-m) if loss == "logistic" else 2 * np.maximum(0, 1 - m))
        vw = 0.9 * vw - 0.5 * (slope.astype(np.float32) @ z + penalty * w)
        vb = 0.9 * vb - 0.5 * float(slope.sum())
        w, b = w + vw, b + vb
    w = w / scale
    return w, float(b - mean @ w)


def calibrate(s: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) for which sigmoid(a * s + b) is the probability of y: Platt's fit by Newton steps."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([s, np.ones(len(s))], 1)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ theta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-3 * theta), -5, 5)
    return float(theta[0]), float(theta[1])
