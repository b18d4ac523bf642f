"""Encoding of whole texts with a public tokenizer file, piece by piece and cached.

A tokenizer of this kind first cuts a text into words (letters, digits or other signs, with a
space before them) and never lets a token reach over such a cut.  Texts are cut there on their
bytes, the pieces of many texts are numbered by an Arrow dictionary, each distinct piece is
encoded by the library once in a while, many in one call, and the ids of a text are gathered
from its pieces.  Texts with characters that aren't plain (see ``CLASS``) are cut at white
space only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textkit as tk

#: White space as the library's patterns have it, and pieces of texts that aren't plain.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Pieces that are encoded alike between others of a call.
JOINS = re.compile(" ?[^\\s\x01]+")
FREE_SPACE = re.compile(b"[a-z] [a-z]")
ODD, LETTER, DIGIT, SIGN, SPACE = range(5)
#: Kinds of bytes.  Of those beyond ASCII only letters of two bytes (U+00C0 to U+024F) are plain.
CLASS = np.full(256, ODD, np.uint8)
CLASS[:128] = SIGN
CLASS[1] = ODD  # stands between the words of a call
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
LEAD = np.zeros(256, bool)
LEAD[0xC3:0xCA] = True
#: New pieces that are encoded in one call; longer texts are slower.
GROUP = 64
MOST_PIECES = 500_000
#: Bytes of the texts that are encoded together.
TOGETHER = 1 << 21


def classes(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text."""
    kind = CLASS[data]
    at = np.flatnonzero(LEAD[data[:-1]])
    a, b = data[at], data[at + 1]
    # the signs for times and divided by, and a capital whose small form has a mark of its own
    at = at[~((a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC4) & (b == 0xB0))]
    kind[at] = kind[at + 1] = LETTER
    return kind


class PieceEncoder:
    """ids of texts by ``tokenizers``; its cache is bounded and starts anew when full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # where a word's end is part of its last token, white space is dropped and letters are small
        self.words_close = any((self.library.id_to_token(i) or "").endswith("</w>") for i in range(self.library.get_vocab_size()))
        self.between = " \x01 " if self.words_close else "\n"
        sign = self.library.encode("\x01" if self.words_close else "\n", add_special_tokens=False).ids
        self.sign = sign[0] if len(sign) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _store(self, keys: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n, total = len(self.known), len(ids)
        while n + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.start[n : n + len(keys)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(keys)] = size
        self.ids[self.used : self.used + total] = ids
        self.used += total

    def _learn(self, keys: list[bytes]) -> None:
        """Encode new pieces: many in one call, with a sign between them that none of them holds."""
        texts = [k.decode() for k in keys]
        joins = [self.sign is not None and JOINS.fullmatch(t) is not None for t in texts]
        joined = [i for i, j in enumerate(joins) if j]
        alone = [i for i, j in enumerate(joins) if not j]
        order: list[int] = []
        ids, sizes = [], []
        for i in range(0, len(joined), 64 * GROUP):
            groups = [joined[j : j + GROUP] for j in range(i, min(i + 64 * GROUP, len(joined)), GROUP)]
            calls = [self.between.join([texts[k] for k in g]) for g in groups]
            for g, found in zip(groups, self.library.encode_batch_fast(calls, add_special_tokens=False), strict=True):
                own = np.array(found.ids, np.uint32)
                between = own == self.sign
                cut = np.flatnonzero(between)
                if len(cut) != len(g) - 1:
                    alone += g
                    continue
                order += g
                ids.append(own[~between])
                sizes.append(np.diff(cut, prepend=-1, append=len(own)) - 1)
        for i in range(0, len(alone), 64 * GROUP):
            part = alone[i : i + 64 * GROUP]
            order += part
            for e in self.library.encode_batch_fast([texts[k] for k in part], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(np.array([len(ids[-1])]))
        self._store([keys[i] for i in order], np.concatenate(ids), np.concatenate(sizes))

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin in the bytes of texts, whether each text is plain, and where white space is."""
        kind = classes(data)
        begin = np.zeros(len(data), bool)
        begin[at[:-1][at[:-1] < len(data)]] = True
        a, b = kind[:-1], kind[1:]
        cut = a != b
        if not self.words_close:
            # white space goes with what follows, except for one line feed
            feed = data[:-1] == 10
            feed[1:] &= (a[:-1] != SPACE) | begin[1:-1]
            cut &= (a != SPACE) | feed
        # an apostrophe may make a word with the letters behind it
        cut &= (data[:-1] != 39) | (b != LETTER)
        begin[1:] |= cut
        odd = np.flatnonzero(kind == ODD)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # may begin a special token
        plain = np.ones(len(at) - 1, bool)
        plain[np.searchsorted(at, np.concatenate([odd, special]), "right") - 1] = False
        return begin, plain, kind == SPACE

    def encode_slices(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, uint32 ids, their offsets) of runs of rows; each null counts as empty."""
        for lo, hi, data, at in tk.slices(column, TOGETHER):
            if len(data) > 2 * TOGETHER:  # one long text
                ids = np.concatenate(list(self._long(data)))
                yield lo, ids, np.array([0, len(ids)])
            else:
                yield lo, *self._encode(data, at)

    def ended(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``encode_slices`` with ``end_id`` behind the ids of each text."""
        for lo, ids, at in self.encode_slices(column):
            out = np.full(len(ids) + len(at) - 1, end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = ids
            yield lo, out, at + np.arange(len(at))

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of parts of a long text, cut at a space between ASCII letters."""
        s = 0
        while s < len(data):
            near = FREE_SPACE.search(data[s + TOGETHER :].data)
            e = s + TOGETHER + near.start() + 1 if near else len(data)
            yield self._encode(data[s:e], np.array([0, e - s], np.int64))[0]
            s = e

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_PIECES:
            self._clear()
        begin, plain, blank = self._cuts(data, at)
        for i in np.flatnonzero(~plain).tolist():
            text = data[at[i] : at[i + 1]].tobytes().decode()
            begin[at[i] : at[i + 1]], blank[at[i] : at[i + 1]] = False, False
            begin[at[i] + np.cumsum([0, *(len(x.encode()) for x in PIECE.findall(text)[:-1])])] = True
        if self.words_close:
            small = tk.LOWER[data]
            if not plain.all():
                small = np.where(np.repeat(plain, np.diff(at)), small, data)
            data, begin, at = small[~blank], begin[~blank], np.concatenate([[0], np.cumsum(~blank)])[at]
        first = np.flatnonzero(begin)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        return self._cached(data, first, at)

    def _cached(self, data: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose pieces begin at ``first``, new pieces being learned, and their offsets."""
        offsets = np.append(first, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = list(map(self.known.get, keys))
        if None in index:
            self._learn([k for k, i in zip(keys, index, strict=True) if i is None])
            index = list(map(self.known.__getitem__, keys))
        where = np.array(index, np.int64)[coded.indices.to_numpy()]
        size = self.size[where]
        stop = np.cumsum(size)
        ids = self.ids[np.arange(int(stop[-1])) + np.repeat(self.start[where] - stop + size, size)]
        return ids, np.concatenate([[0], stop])[np.searchsorted(first, at)]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_slices(pa.array([text], pa.string())))[1]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
