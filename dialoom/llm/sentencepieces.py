"""Exact merge-type encoding of whole texts with a public sentencepiece model, and decoding.

A merge-type tokenizer joins the neighbours whose union has the best score until none is left.
The same ids come from backtracking: at each place the longest piece found by an Aho-Corasick
automaton is tried, then shorter ones; a piece may follow another only if merging the text of
both again gives exactly these two; a bit for each place marks those from which no way led on.
Many words are walked through in step, as arrays.

Texts are cut on their bytes where no piece crosses, each distinct cut is encoded once in a
while (see ``tokens.PieceEncoder``), and the ids of a text are gathered from its cuts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .store import map_batches
from .tokens import TOGETHER, PieceEncoder

SPACE_MARK = "▁"
#: Slots of the table of pairs of pieces that were merged again.
PAIR_SLOTS = 1 << 21
#: Below so many words in step, each is walked alone.
FEW = 24
#: Code points that the automaton sees together.
JOINED = 200_000
#: Distinct cuts of texts whose ids are kept; the cache starts anew beyond.
MOST_CUTS = 300_000
#: Stands between words that the automaton sees together.
APART = "\n"
WORD_END = re.compile(b"[^ ] ")
NONE = -1
RAW, CONTROL, UNKNOWN = 0, 1, 2


class MergeModel:
    """Pieces and scores of a model file, with the searches that encoding needs.

    Models whose text is changed by more than the mark for spaces are refused, as this encodes
    texts as they are.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " ﬁ  Á　 "
        shown = sp.normalize(probe) if hasattr(sp, "normalize") else "".join(sp.encode(probe, out_type=str))
        if shown.replace(SPACE_MARK, " ") != " " + probe:
            raise ValueError("the model normalises texts or adds no space in front")
        self.library = sp
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.kind = np.array([CONTROL if sp.is_control(i) else UNKNOWN if sp.is_unknown(i) else RAW for i in range(n)], np.uint8)
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        merges = [i for i in range(n) if self.kind[i] == RAW and not byte[i] and not sp.is_unused(i)]
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in merges}
        self.ids = {self.pieces[i]: i for i in merges}
        # pieces that merging never makes are no candidates
        self.automaton = ahocorasick.Automaton()
        self.left_edge: dict[int, list[str]] = {}
        self.right_edge: dict[int, list[str]] = {}
        for p, i in self.ids.items():
            parts, self.left_edge[i], self.right_edge[i] = self.merged(p)
            if parts == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: The next shorter piece that a piece begins with.
        self.shorter = np.full(n, NONE, np.int64)
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), NONE)
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.most = max(map(len, self.ids))
        self.letters = {c for p in self.ids for c in p}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("the model has pieces over more than one word")
        if APART in self.letters or any(c not in self.automaton for c in self.letters):
            raise ValueError("the model has pieces with line feeds, or lacks letters of its pieces")
        #: What a piece is in decoded text.
        self.bytes = [bytes([int(p[1:-1], 16)]) if byte[i] else b"" if self.kind[i] == CONTROL else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = np.array(byte)
        self.pair_key = np.full(PAIR_SLOTS, NONE, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)

    def merged(self, text: str, border: int = 0) -> tuple[list[str], list[str], list[str]]:
        """The pieces of a short text by merging: the best score first, of equal ones the leftmost.

        Also what stood first and what stood last at any time.  A merge over ``border`` ends it.
        """
        parts, at = list(text), list(range(len(text)))
        firsts, lasts = parts[:1], parts[-1:]
        while True:
            best, k = None, NONE
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, k = r, i
            if k < 0 or (border and at[k + 1] == border):
                return parts if k < 0 else [], firsts, lasts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del at[k + 1]
            if k == 0:
                firsts.append(parts[0])
            if k == len(parts) - 1:
                lasts.append(parts[-1])

    def stays(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces again gives exactly these: no merge may cross between them."""
        if not any(x + y in self.rank for x in self.right_edge[a] for y in self.left_edge[b]):
            return True
        return bool(self.merged(self.pieces[a] + self.pieces[b], len(self.pieces[a]))[0])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stays`` for arrays of pairs, remembered in a table of bounded size."""
        key = a * len(self.pieces) + b
        slot = (key * -7046029254386353131 >> 40) & (PAIR_SLOTS - 1)
        out = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            ok = np.array([self.stays(*divmod(k, len(self.pieces))) for k in fresh.tolist()], bool)
            out[new] = ok[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], out[new]
        return out

    def longest(self, text: str, at: int, end: int) -> int:
        """The longest piece that begins at a place; each letter in ``letters`` is a piece."""
        return next(self.automaton.iter_long(text[at : min(end, at + self.most)]))[1]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (marks for spaces in place) one after the other, and how many each has."""
        ids, sizes = [], []
        lo = 0
        while lo < len(words):
            hi, total = lo, 0
            while hi < len(words) and (hi == lo or total + len(words[hi]) <= JOINED):
                total += len(words[hi])
                hi += 1
            a, b = self._encode_joined(words[lo:hi])
            ids.append(a)
            sizes.append(b)
            lo = hi
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # runs of letters that some piece has; other letters stand alone and become bytes
        runs: list[str] = []
        of_run: list[int] = []
        alone: list[tuple[int, int, str]] = []  # word, place among its runs, letter
        for w, word in enumerate(words):
            if self.letters.issuperset(word):
                runs.append(word)
                of_run.append(w)
                continue
            s = 0
            for i, c in enumerate(word):
                if c not in self.letters:
                    if s < i:
                        runs.append(word[s:i])
                        of_run.append(w)
                    alone.append((w, len(runs), c))
                    s = i + 1
            if s < len(word):
                runs.append(word[s:])
                of_run.append(w)
        ids, n_ids = self._walk(runs)
        if not alone:
            return ids, np.bincount(np.repeat(np.array(of_run, np.int64), n_ids), minlength=len(words))
        stop = np.concatenate([[0], np.cumsum(n_ids)])
        out, sizes, at = [], np.zeros(len(words), np.int64), 0
        np.add.at(sizes, np.array(of_run, np.int64), n_ids)
        for w, run, c in alone:
            raw = self.byte_ids[np.frombuffer(c.encode(), np.uint8)]
            out += [ids[at : stop[run]], raw]
            at = stop[run]
            sizes[w] += len(raw)
        return np.concatenate([*out, ids[at:]]), sizes

    def _walk(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Backtracking through all runs in step; ids one after the other, and their number in each run."""
        size = self.size
        length = np.array([len(r) for r in runs], np.int64)
        text = APART.join(runs)
        begin = np.cumsum(length + 1) - length - 1
        end = begin + length
        longest = np.full(len(text) + 1, NONE, np.int64)  # by place: the longest piece that begins there, once it is known
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        longest[found[:, 0] + 1 - size[found[:, 1]]] = found[:, 1]
        dead = np.zeros(len(text) + 1, bool)  # places from which no way leads on
        chosen = np.full(len(text) + 1, NONE, np.int64)  # by place: the piece that begins there
        before = np.full(len(text) + 1, NONE, np.int64)  # by place: where the piece before it begins
        at = begin.copy()
        token = longest[at] if len(runs) else at
        live = np.arange(len(runs))
        while len(live) > FEW:
            none = token[live] < 0
            # no candidate is left: this place is dead, and the piece before it gives way to its next shorter one
            back = live[none]
            if len(back):
                here = at[back]
                dead[here] = True
                prev = before[here]
                at[back] = prev
                token[back] = self.shorter[chosen[prev]]
            some = live[~none]
            p, t = at[some], token[some]
            to = p + size[t]
            ok = ~dead[to]
            follow = ok & (p > begin[some])
            ok[follow] = self.compatible(chosen[before[p[follow]]], t[follow])
            bad, good = some[~ok], some[ok]
            token[bad] = self.shorter[t[~ok]]
            chosen[p[ok]] = t[ok]
            reached = to[ok]
            at[good] = reached
            inside = reached < end[good]
            onward = reached[inside]
            before[onward] = p[ok][inside]
            unknown = np.flatnonzero(longest[onward] < 0)
            if len(unknown):
                where = onward[unknown]
                longest[where] = [self.longest(text, i, j) for i, j in zip(where.tolist(), end[good[inside][unknown]].tolist(), strict=True)]
            token[good[inside]] = longest[onward]
            live = live[at[live] < end[live]]
        for r in live.tolist():
            self._walk_one(text, int(begin[r]), int(end[r]), int(at[r]), int(token[r]), chosen, before, dead)
        return self._gather(begin, end, chosen)

    def _walk_one(self, text: str, begin: int, end: int, p: int, token: int, chosen, before, dead) -> None:
        """The same for a single run, from where it stands."""
        pairs: dict[tuple[int, int], bool] = {}
        while p < end:
            if token < 0:
                dead[p] = True
                p = int(before[p])
                token = int(self.shorter[chosen[p]])
                continue
            to = p + int(self.size[token])
            ok = not dead[to]
            if ok and p > begin:
                pair = (int(chosen[before[p]]), token)
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= PAIR_SLOTS:
                        pairs.clear()
                    ok = pairs[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
            if not ok:
                token = int(self.shorter[token])
                continue
            chosen[p] = token
            if to < end:
                before[to] = p
                token = self.longest(text, to, end)
            p = to

    def _gather(self, begin: np.ndarray, end: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each run: from its begin, each piece leads to the next."""
        at, live = begin.copy(), np.flatnonzero(end > begin)
        used = np.zeros(len(chosen), bool)
        while len(live) > FEW:
            p = at[live]
            used[p] = True
            at[live] = p + self.size[chosen[p]]
            live = live[at[live] < end[live]]
        for r in live.tolist():
            p = int(at[r])
            while p < end[r]:
                used[p] = True
                p += int(self.size[chosen[p]])
        where = np.flatnonzero(used)
        return chosen[where], np.searchsorted(where, end) - np.searchsorted(where, begin)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids, as the library gives it; ids of whole letters need no library."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not self.kind[ids].any():
            raw = b"".join([self.bytes[i] for i in ids.tolist()])
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                return self.library.decode(ids.tolist())
            return text[1:] if self.pieces[ids[0]].startswith(SPACE_MARK) else text
        return self.library.decode(ids.tolist())


class MergeEncoder(PieceEncoder):
    """ids of texts by a ``MergeModel``, with the bounded cache of cuts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = MergeModel(path)
        self._clear()

    def _learn(self, keys: list[bytes]) -> None:
        words = [k.decode().replace(" ", SPACE_MARK) for k in keys]
        ids, sizes = self.model.encode_words(words)
        self._store(keys, ids, sizes)

    def encode_slices(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, their offsets) of runs of rows; a null counts as empty, a mark as a space."""
        text = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), SPACE_MARK, " ")
        begun = pc.binary_join_element_wise(pc.if_else(pc.equal(text, ""), "", " ").cast(pa.large_string()), text, pa.scalar("", pa.large_string()))
        yield from super().encode_slices(begun)

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_CUTS:
            self._clear()
        begin = np.zeros(len(data), bool)
        begin[at[:-1][at[:-1] < len(data)]] = True
        begin[1:] |= (data[1:] == 32) & (data[:-1] != 32)  # a run of spaces goes with what follows
        feed = data == 10  # a line feed is in no piece
        begin |= feed
        begin[1:] |= feed[:-1]
        first = np.flatnonzero(begin)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        return self._cached(data, first, at)

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of parts of a long text, cut in front of spaces."""
        s = 0
        while s < len(data):
            near = WORD_END.search(data[s + TOGETHER :].data)
            e = s + TOGETHER + near.start() + 1 if near else len(data)
            yield self._encode(data[s:e], np.array([0, e - s], np.int64))[0]
            s = e


_encoders: dict[str, MergeEncoder] = {}


def encoder(path: str) -> MergeEncoder:
    """The encoder of this Python worker for a model file."""
    if path not in _encoders:
        _encoders[path] = MergeEncoder(path)
    return _encoders[path]


def _ragged(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


def _spelled(ids: np.ndarray, at: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ``table`` has for each id, one after the other, and the offsets of each text in them."""
    flat, start, size = table
    own = size[ids]
    stop = np.concatenate([[0], np.cumsum(own)])
    data = flat[np.arange(int(stop[-1])) + np.repeat(start[ids] - stop[:-1], own)]
    return data, stop[at]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the ids of the whole text without begin or end ids."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "ids")
    docs = docs.select(*[c for c in docs.columns if c != "ids"])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo, ids, at in enc.encode_slices(batch.column(text)):
                own = batch.slice(lo, len(at) - 1)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*own.schema.names, "ids"])

    return map_batches(docs, run, f"{kind}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of any array of ids; null ids give a null text."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "decoded")
    tokens = tokens.select(*[c for c in tokens.columns if c != "decoded"])

    def run(batches):
        model = encoder(path).model
        for batch in batches:
            texts = [None if v is None else model.decode(v) for v in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_batches(tokens, run, f"{kind}, decoded string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again.

    A null or empty text has no ids and decodes to an empty text; each repeated row has its row;
    ids of documents may be null.  A text is encoded whole, in parts of bounded size, however
    long; other columns are ignored.
    """

    def run(batches):
        enc = encoder(path)
        model = enc.model
        decimal = _ragged([f"{i},".encode() for i in range(len(model.pieces))])
        letters = _ragged(model.bytes)
        leads = np.array([p.startswith(SPACE_MARK) for p in model.pieces])
        for batch in batches:
            for lo, ids, at in enc.encode_slices(batch.column("text")):
                ids = ids.astype(np.int64)
                told, told_at = _spelled(ids, at, decimal)
                text, text_at = _spelled(ids, at, letters)
                n = np.diff(at)
                shas, texts = [], []
                plain = np.ones(len(n), bool)
                odd = model.kind[ids] != RAW
                if odd.any():  # unknown letters of a model without bytes
                    plain[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
                for i in range(len(n)):
                    shas.append(hashlib.sha256(told[told_at[i] : max(told_at[i], told_at[i + 1] - 1)]).hexdigest())
                    if n[i] and plain[i]:
                        texts.append(hashlib.sha256(text[text_at[i] + int(leads[ids[at[i]]]) : text_at[i + 1]]).hexdigest())
                    else:
                        texts.append(hashlib.sha256(model.decode(ids[at[i] : at[i + 1]]).encode()).hexdigest())
                own = batch.column("doc_id").slice(lo, len(n)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(shas), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
