"""Backtracking against the library's own encoding and decoding."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import sentencepieces, tokens
from dialoom.llm.queries import op12_backtracking_pieces, tokenizer_path

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def enc():
    return sentencepieces.MergeEncoder(tokenizer_path("piece_bpe_32k.model"))


def texts_of(enc, seed, n=400):
    rng = random.Random(seed)
    letters, pieces = "ab thein▁ \n\t.,;'\"{}()éß日本ゼ梦🙂\x01\x00-_=+0123456789ABC  ", list(enc.model.ids)
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(n)]
    some += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 50))) for _ in range(n)]
    fixed = [None, "", " ", "   ", "a", " a", "a ", "x      y", "▁x▁ y", " ▁ ▁▁a", "\n\n a\n", "é𝒜b\x00c", "<s> </s> <0x41><unk>", "a" * 3000, " " * 777, "\r\n\t", "Á ﬁ ﷺ", "🙂" * 90, "日本語。" * 400]
    return fixed + some


def encoded(enc, texts):
    out = []
    for _, ids, at in enc.encode_slices(pa.array(texts, pa.string())):
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)]
    return out


@pytest.mark.parametrize("few", [0, 24, 10**9])  # all in step, as it is, each alone
def test_ids_equal_the_library(enc, monkeypatch, few):
    monkeypatch.setattr(sentencepieces, "FEW", few)
    enc._clear()
    texts = texts_of(enc, few)
    assert encoded(enc, texts) == enc.model.library.encode([t or "" for t in texts])


def test_small_tables_and_caches(enc, monkeypatch):
    """Pairs that share a slot, a cache that is often cleared, and words that the automaton sees alone."""
    for name, value in (("PAIR_SLOTS", 64), ("MOST_CUTS", 20), ("JOINED", 10)):
        monkeypatch.setattr(sentencepieces, name, value)
    monkeypatch.setattr(enc.model, "pair_key", np.full(64, -1, np.int64))
    monkeypatch.setattr(enc.model, "pair_ok", np.zeros(64, bool))
    enc._clear()
    texts = texts_of(enc, 5, 60)
    assert encoded(enc, texts) == enc.model.library.encode([t or "" for t in texts])


def test_long_texts_in_parts(enc, monkeypatch):
    monkeypatch.setattr(sentencepieces, "TOGETHER", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 50)
    texts = ["the quick  brown fox\n" * 40, "a  b" * 300, "日本語" * 100, "x " * 200 + "▁▁ y", *texts_of(enc, 6, 40)]
    assert encoded(enc, texts) == enc.model.library.encode([t or "" for t in texts])


def test_pieces_stay_only_if_merging_keeps_them(enc):
    m, rng = enc.model, random.Random(7)
    pieces = list(m.ids.values())
    for _ in range(3000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert m.stays(a, b) == (m.merged(m.pieces[a] + m.pieces[b])[0] == [m.pieces[a], m.pieces[b]])


def test_backtracking_is_needed(enc):
    """Words whose longest first piece is wrong: the greedy way would give other ids."""
    m = enc.model
    words = [w for w in ("▁" + a + b for a in ("the", "an", "in", "st") for b in ("rein", "other", "sing", "ough", "ated", "ning")) if m.pieces[m.longest(w, 0, len(w))] != m.merged(w)[0][0]]
    assert words
    ids, sizes = m.encode_words(words)
    stop = np.cumsum(sizes)
    assert [[m.pieces[i] for i in ids[e - n : e]] for n, e in zip(sizes, stop, strict=True)] == [m.merged(w)[0] for w in words]


def test_any_ids_decode_as_the_library_does(enc):
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 30))]
        assert enc.model.decode(np.array(ids)) == enc.model.library.decode(ids)


def test_tables_of_ids(spark, enc):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = texts_of(enc, 9, 30)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "a", "x", 1), (None, "no id", "y", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lib = enc.model.library

    def want(t):
        ids = lib.encode(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    got = sentencepieces.round_trips(docs, path).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *want(t))) for i, t, *_ in rows)
    full = sentencepieces.encode_texts(docs, path)
    assert full.columns == ["doc_id", "text", "n_tokens", "ids"]
    back = sentencepieces.decode_ids(full, path).collect()
    assert all(r.ids == lib.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert sentencepieces.round_trips(docs.limit(0), path).collect() == []


def test_query_on_the_smallest_tables(spark, enc):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.ids_sha256 for r in op12_backtracking_pieces(spark, d).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, enc.model.library.encode(t))).encode()).hexdigest() for i, t in texts.items()}
