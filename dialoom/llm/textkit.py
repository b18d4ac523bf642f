"""Vectorised text helpers on Arrow buffers: words, hashes and shingles of whole texts.

Everything works on the UTF-8 bytes of many texts at once, so that a task never holds
more than a slice of its Arrow batch in intermediate arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit value of each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = int(_rng.integers(0, 2**63)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 2**64)
WORD_BASES = _rng.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}

#: The word separators of the contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one slice of a batch takes at most (a longer single text is its own slice).
SLICE_BYTES = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        out = np.empty(size, U64)
        out[0] = 1
        k = 1
        while k < size:
            out[k : 2 * k] = out[:k] * U64(pow(base, k, 2**64))
            k *= 2
        if size > 4 * SLICE_BYTES:
            return out  # of a very long text; not kept
        _powers[base] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches all output bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gives the hash of any span of ``data``."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, max(1, len(data)))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end); equal bytes have equal hashes anywhere."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``most`` bytes."""
    raw, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts, and the text that each belongs to."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begins[first] |= inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[data] if lower else data), start, end)


def windows(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word and hash of each run of k words within a text.

    With ``short``, a text of fewer words gives its whole sequence as one run.
    """
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    stop = np.cumsum(counts)
    left = (stop[row] - np.arange(len(row))) if len(row) else np.zeros(0, np.int64)
    where = left >= k
    if short:
        begin = stop - counts
        few = (counts > 0) & (counts < k)
        where[begin[few]] = True
    at = np.flatnonzero(where)
    out = np.zeros(len(at), U64)
    size = np.minimum(left[at], k)
    for j in range(k):
        ok = size > j
        if ok.all():
            out += hashes[at + j] * WORD_BASES[j]
        else:
            out[ok] += hashes[at[ok] + j] * WORD_BASES[j]
    return at, mix(out + size.astype(U64))
