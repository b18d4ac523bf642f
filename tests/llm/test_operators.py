"""The operators of dialoom.llm against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.llm import components, hashed, langid, minhash, mixing, packing, pagetext, quality, suffixdedup, tokenfile, tokens, topk, toxicity
from dialoom.llm.queries import OP7_SQL, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, spans int"
DATA = "/root/testdata/sf0.001"


def prose(n, seed, vocab=4000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocab, n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in each column, empty, short, long, equal and near-equal texts, repeated ids, clashing names."""
    long = prose(20_000, 1)
    base = prose(300, 2).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(20, 280, 13)]
    texts = [None, "", " \n\t ", "one", "ONE", "two words", "two  words", long, long + " tail", "é\x00ü 中文 ß", prose(60, 3), prose(60, 3), *near, prose(400, 5) + "\n" + " ".join(base[:80]), " ".join(base[10:95]) + " " + prose(50, 6), "ab" * 300]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "x", i) for i, t in enumerate(texts)]
    rows += [(10, texts[10], "en", "s2", 1, "x", 1), (None, "no id here", None, None, None, None, None), (None, long, "en", None, 3, "y", 2), (5, prose(70, 9), "en", "s1", 1, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def shingles(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, p):
    """Brute force: components over ids of all pairs of rows that are linked."""
    sets = [shingles(t, p.words) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None in (rows[a][0], rows[b][0]) or not sets[a] or not sets[b]:
                continue
            n = len(sets[a] & sets[b])
            if 100 * n >= p.percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("p", [minhash.NearDup(3, 85, 6), minhash.NearDup()])
def test_near_duplicates(awkward, p):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = minhash.near_duplicates(awkward, p).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == groups(rows, p)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_one(awkward, p)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    heads = {r.component_id for r in got if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(heads) and ids.count(None) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = tokenizer_path("word_bpe_49k.json")
    for df in (minhash.near_duplicates(none), minhash.keep_one(none), suffixdedup.remove_repeats(none), suffixdedup.without_repeats(none), mixing.mix(none), mixing.mixed_documents(none), packing.pack(none, path), tokenfile.token_digests(none, tokenizer_path("byte_bpe_50k.json"))):
        assert df.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, quality.train(none, labels)).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert pagetext.extract_pages(pages, pagetext.train(pages)).count() == 0


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)])) for _ in range(2))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = minhash.pack(minhash.minima([a, b], 1024))
        match = 1 - minhash.mismatches(sig[0], sig[1]) / 1024
        assert abs((match - 1 / 16) / (1 - 1 / 16) - truth) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 9), (9, 1), (200, 3), (3, 150)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[9] == 1 and got[1] == 1 and all(got[i] == 3 for i in [*range(100, 161), 200])


def removed(texts, n=200):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        keep = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return out


def test_suffix_dedup(spark, awkward, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = sorted(((i, *w) for (i, _), w in zip(rows, removed([(t or "").encode() for _, t in rows]))), key=repr)
    assert sorted(map(tuple, suffixdedup.remove_repeats(awkward).collect()), key=repr) == want
    cut = suffixdedup.without_repeats(awkward)
    assert cut.columns == awkward.columns and cut.count() == len(rows)


def test_suffix_dedup_boundaries(spark):
    rng = np.random.default_rng(8)
    pick = lambda n: "".join(rng.choice(list("abcdeé\n "), n))
    shared = [pick(n) for n in (199, 200, 201, 260, 900)]
    texts = [pick(int(rng.integers(0, 400))) + shared[i % 5][int(rng.integers(0, 3)) :] + pick(int(rng.integers(0, 300))) for i in range(60)] + ["xyz" * 500, "q" * 199, "q" * 200, "z" * 201]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffixdedup.remove_repeats(df).orderBy("doc_id").collect()]
    assert got == removed([t.encode() for t in texts])


def test_long_text_in_parts():
    size = 5 * suffixdedup.tk.SLICE_BYTES // 2
    data = np.random.default_rng(9).integers(97, 101, size).astype(np.uint8).tobytes().decode()
    parts = [(lo, shift, len(d)) for lo, shift, d, _ in suffixdedup.pieces(pa.array(["x", data]), 199)]
    assert [p[0] for p in parts] == [0, 1, 1, 1] and parts[-1][1] + parts[-1][2] == size
    assert all(a[1] + a[2] == b[1] + 199 for a, b in zip(parts[1:-1], parts[2:]))


def test_suffix_dedup_across_cuts_of_long_texts(spark):
    cut, n = suffixdedup.tk.SLICE_BYTES, 200
    rng = np.random.default_rng(11)
    pick = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    unique, copied = pick(3 * cut + 700), pick(2 * cut + 900)
    texts = [unique, copied, pick(90) + copied[cut - 333 : cut + 444] + pick(70), pick(250)]
    hashes = [np.fromiter((hash(t[i : i + n]) for i in range(len(t) - n + 1)), np.int64, len(t) - n + 1) for t in texts]
    value, count = np.unique(np.concatenate(hashes), return_counts=True)
    want = []
    for t, h in zip(texts, hashes):
        gone = np.zeros(len(t), bool)
        for i in np.flatnonzero(np.isin(h, value[count > 1])):
            gone[i : i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert [w[1:3] for w in want] == [(0, 0), (777, 1), (777, 1), (0, 0)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in suffixdedup.remove_repeats(df).orderBy("doc_id").collect()] == want
    # rows that are equal in id and text are still two places
    twice = df.where("doc_id = 0").union(df.where("doc_id = 0"))
    assert [r.n_removed for r in suffixdedup.remove_repeats(twice).collect()] == [len(unique)] * 2


def test_runs_do_not_depend_on_cuts(monkeypatch):
    data = [np.random.default_rng(s).integers(97, 123, n).astype(np.uint8).tobytes().decode() for s, n in ((1, 300), (2, 9000), (3, 250), (4, 150), (5, 5000))]

    def found():
        out = []
        for row, shift, _, at, (text, h, lo, hi, pick) in suffixdedup.whole_runs(pa.array(data), 200, 32):
            out += zip((text + row).tolist(), h.tolist(), *((x - at[text] + shift).tolist() for x in (lo, hi, pick)), strict=True)
        return out

    want = found()
    for size in (1, 50, 199, 1000, 2222):
        monkeypatch.setattr(suffixdedup.tk, "SLICE_BYTES", size)
        monkeypatch.setattr(suffixdedup.tk.slices, "__defaults__", (size,))
        assert found() == want


def test_mixing(spark, awkward):
    rows = awkward.collect()
    got = mixing.mix(awkward).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in rows)
    size = Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    total, caps, order = 1.5 * sum(size.values()), {s: 2.0 * n for s, n in size.items()}, sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # reshare the excess until none is above
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > caps[s]}
        if not over:
            target |= share
            break
        target |= {s: caps[s] for s in over}
        open_ -= over
    taken = Counter()
    for r in got:
        assert r.copies * r.size <= 2 * r.size
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] += r.copies * r.size
    biggest = Counter()
    for r in got:
        biggest[r.source] = max(biggest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in size)
    again = mixing.mix(awkward.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mixed_documents(awkward).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_mixing_of_repeated_rows_in_levels(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "GROUP", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(mixing, "SHARE", 3)
    monkeypatch.setattr(mixing, "STEP", 7)
    rng = np.random.default_rng(21)
    rows = [(i, prose(int(rng.integers(1, 60)), i), None if i % 7 == 0 else f"s{min(i % 11, 4)}") for i in range(1500)]
    rows += [(3, "the same words again and again", "s3")] * 700 + [(None, "no id", "s1")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(WORD.findall(t))) for i, t, s in rows)
    taken, biggest, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        biggest[r.source] = max(biggest[r.source], r.size)
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= biggest[s] for s, t in target.items())
    same = [r.copies for r in got if r.doc_id == 3 and r.size == 6]
    assert max(same) - min(same) <= 1
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    found = Counter((r.doc_id, r.source, len(WORD.findall(r.text))) for r in mixing.mixed_documents(df).collect())
    assert found == +want


def test_pieces_equal_whole_encoding(monkeypatch):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    signs = list("abÉé1'.#<|> \n«²ª\tЖ中!?-_`~^\xa0　\x1c×÷ĳ\x01") + ["<|endoftext|>", "<|startoftext|>", "'s", "́"]
    texts = ["", *("".join(rng.choice(signs, int(rng.integers(1, 40)))) for _ in range(3000))]
    plain = [*"abÉé1'.,|çß \n-_İŉ\t\r", " ", " ", "  ", "\n\n", "\n ", "don't", "'s", "'ll", "end.\nNext", "WORD!!", "42", "ǆ"]
    texts += ["".join(rng.choice(plain, int(rng.integers(1, 60)))) for _ in range(6000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(tokenizer_path(name))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        own = tokens.PieceEncoder(tokenizer_path(name))
        for _ in range(2):  # new pieces, then known ones
            got = [ids[s:e].tolist() for _, ids, at in own.encode_slices(pa.array(texts)) for s, e in zip(at[:-1], at[1:])]
            assert got == want
        monkeypatch.setattr(tokens, "TOGETHER", 50)
        long = texts[3001:3200]
        assert [own.encode(" and so on ".join(long)).tolist()] == [library.encode(" and so on ".join(long), add_special_tokens=False).ids]
        monkeypatch.undo()


def test_packing(awkward):
    path = tokenizer_path("word_bpe_49k.json")
    encode = tokens.PieceEncoder(path).encode
    got = packing.pack(awkward, path).collect()
    want = Counter()
    for r in awkward.collect():
        ids = np.append(encode(r.text), 1).astype("<u4")
        want.update((r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(3)
    hist = np.zeros(2049, np.int64)
    np.add.at(hist, np.minimum(2048, rng.geometric(0.003, 20_000)), 1)
    steps, n = packing.plan(hist)
    used = Counter()
    for lengths, k in steps:
        assert sum(a * m for a, m in lengths) <= 2048
        for a, m in lengths:
            used[a] += k * m
    assert all(used[i] == hist[i] for i in range(1, 2049))
    assert n * 2048 < 1.02 * (hist * np.arange(2049)).sum() + 2048


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for trial in range(200):
        ids = rng.integers(0, 2 ** int(rng.integers(1, 64)), int(rng.integers(0, 900)), dtype=np.uint64)
        if trial % 5 == 0:
            ids[: len(ids) // 2] = 0
        elif trial % 5 == 1:
            ids = ids[ids < 2**60]
        words, blocks, escapes = tokenfile.encode_words(ids)
        assert (tokenfile.decode_words(words, escapes) == ids).all()
        if len(ids) > 2:
            s, e = sorted(rng.choice(len(ids), 2, replace=False))
            assert (tokenfile.decode_range(words, blocks, escapes, int(s), int(e)) == ids[s:e]).all()


def test_runs_of_zeros_take_one_word():
    words, _, escapes = tokenfile.encode_words(np.zeros(500, np.uint64))
    assert (words >> np.uint64(60)).tolist().count(1) == 4 and (tokenfile.decode_words(words, escapes) == 0).all()


def test_token_files(spark, awkward, tmp_path, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    encode = tokens.PieceEncoder(path).encode
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.tag, r.text or "") for r in awkward.withColumn("tag", F.xxhash64("text")).collect())
    at, want, every = 0, [], []
    for i, _, t in rows:
        ids = np.append(encode(t), 2).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        every += ids.tolist()
        at += len(ids)
    monkeypatch.setattr(tokenfile, "READ_BLOCKS", 3)
    got = [(r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_digests(awkward, path, path=f"{tmp_path}/ids").collect()]
    assert sorted(got) == sorted(want)
    for s, e in ((0, 3), (5_000, 40_000), (at - 9, at + 9)):
        parts = tokenfile.read_ids(spark, f"{tmp_path}/ids", s, e).orderBy("start").collect()
        assert parts[0].start == s and sum((r.ids for r in parts), []) == every[s:e]


def test_quality_counts():
    base = prose(12, 4)
    texts = [None, "", " \n \n", f"{base}\n{base}\n\n{base} x", "# a | b\n# a | b", "é中 ü", (base + " ") * 3, prose(40, 8)]
    got = quality.counts(pa.array(texts))
    for t, row in zip(texts, got.tolist()):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, cover = Counter(runs), set()
        for i, r in enumerate(runs):
            if n[r] > 1:
                cover |= set(range(i, i + 8))
        assert row == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)]


def test_models_on_labelled_rows(spark, awkward):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, quality.train(docs, labels)).join(labels, "doc_id").where("not base_failed")
    good = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert good > 0.95
    found = langid.identify(docs, langid.train(docs.where("doc_id % 4 <> 0"))).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 0")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = langid.train(docs)
    odd = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the and of")], "doc_id long, text string"), model).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[4] != "und"
    assert langid.identify(awkward, model).count() == awkward.count()


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        w = [f"word{x}" for x in rng.integers(0, 300, 60)]
        if i % 3 == 0:
            w[int(rng.integers(0, 60))] = ("awful", "nasty")[i % 2]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    params = toxicity.train(df, df.where("doc_id % 5 <> 0"))
    got = toxicity.score(df, params).join(df.select("doc_id", "toxic"), "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "  !")], "doc_id long, text string"), params).collect()
    assert all(0 <= r.score < 0.5 for r in odd)


def test_gradients_of_the_network():
    rng = np.random.default_rng(12)
    texts = pa.array([prose(70, 1, 30), prose(20, 2, 30), "one", prose(45, 3, 30)])
    raw, at = toxicity.tk.buffers(texts)
    s = toxicity.Slice(raw[at[0] : at[-1]], at - at[0])
    p = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in toxicity.initial(s.words[:10]).items()}
    x = rng.standard_normal((len(s.words) + 1, toxicity.DIM))
    x[-1] = 0
    d, begin = rng.standard_normal(len(s.index)), s.starts // 2

    def loss():
        return float(toxicity.forward(p, x, s.index, begin, False)[0] @ d)

    logit, kept = toxicity.forward(p, x, s.index, begin, True)
    g, d_x = toxicity.backward(p, x, s.index, kept, d)
    for name, grad in [*g.items(), ("x", d_x[:-1])]:
        value = x[:-1] if name == "x" else p[name]
        for i in rng.integers(0, value.size, 4):
            at, old = np.unravel_index(i, value.shape), value.flat[i]
            value[at] = old + 1e-3
            up = loss()
            value[at] = old - 1e-3
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-2 * max(1, abs(grad[at])), name


def test_all_overlapping_windows_are_scored():
    sizes = [0, 1, 31, 32, 33, 63, 64, 65, 300]
    raw, at = toxicity.tk.buffers(pa.array([prose(n, n, 50) for n in sizes]))
    s = toxicity.Slice(raw[at[0] : at[-1]], at - at[0])
    p = toxicity.initial(s.words[:20])
    got = toxicity.window_scores(p, s)
    x, seen = toxicity.word_inputs(p, s), Counter()
    for block, begin in np.argwhere(np.isfinite(got)):
        one = toxicity.forward(p, x, s.index[[block]], np.array([begin]), False)[0][0]
        assert abs(one - got[block, begin]) < 1e-4
        seen[sizes[s.owner[block]]] += 1
    assert seen == {n: max(1, n - 31) for n in sizes if n}
    # the words of a text's windows, in order, are its own
    flat = [s.index[b, k] for b in np.flatnonzero(s.owner == 8) for k in range(s.starts[b])]
    assert [s.words[i] for i in flat] == list(toxicity.tk.span_hash(toxicity.tk.prefix_hash(raw), *toxicity.tk.words(raw, at)[:2])[-300:-31])


def test_scores_of_awkward_rows(spark, awkward):
    labels = awkward.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "cast(doc_id % 2 as int) as quality", "'x' as text")
    wide = awkward.select("*", F.lit(1).alias("label"), F.lit(2.0).alias("score"), F.lit("x").alias("letter"))
    network, model = toxicity.train(wide, labels), quality.train(wide, labels)
    for got in (toxicity.score(wide, network), quality.judge(wide, model), langid.identify(wide, langid.train(wide))):
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in awkward.collect())
    n_words = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in awkward.collect())
    assert Counter((r.doc_id, r.n_words) for r in quality.judge(wide, model).collect()) == n_words
    assert quality.keep_good(wide, model).columns == wide.columns


@pytest.mark.parametrize("chunk", [512, 6])
def test_large_buckets_lose_no_link(spark, monkeypatch, chunk):
    """Near copies of two texts, and chains of copies, in buckets of many chunks."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 4 << 20 if chunk > 6 else 20_000)
    rng = np.random.default_rng(41)
    rows = []
    for k, size in ((0, 60), (1, 25)):
        base = prose(300, 50 + k).split()
        for _ in range(size):
            words = list(base)
            for at in rng.integers(0, 300, int(rng.integers(1, 9))):
                words[at] = f"n{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(words)))
    chain = prose(300, 60).split()
    for i in range(12):
        chain = chain[8:] + prose(8, 70 + i).split()
        rows.append((len(rows), " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = minhash.NearDup()
    got = minhash.near_duplicates(df, p).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == groups(rows, p)


@pytest.mark.parametrize("spread", [1, 300])
def test_best_keeps_all_that_reach_the_floor(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-9, 9, (700, 12)).astype(float)
    c[::spread] *= 40  # few rows far ahead: sparse survivors; all alike: one matrix product
    ids = rng.permutation(len(c))
    q_ids, q = ids[:300], c[:300]
    score = (q @ c.T).astype(int)
    want = [sorted((-int(score[i, j]), int(ids[j])) for j in range(len(c)) if ids[j] != q_ids[i])[:5] for i in range(len(q))]
    for floors in (np.full(len(q), -np.inf), np.array([-w[-1][0] for w in want], float)):
        got: list[list] = [[] for _ in want]
        for at, cand, value in zip(*topk.best(q_ids, q, floors, ids, c, 5), strict=True):
            got[at].append((-int(value), int(cand)))
        assert [sorted(g) for g in got] == want


def test_topk(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((230, 7)).astype(np.float32)
    x[101] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500, None, 1), (550, [1.0] * 6 + [None], 1), (600, [float("nan")] * 7, 1), (None, [1.0] * 7, 1), (650, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ints = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = set()
    for q in range(0, 230, 50):
        s = ints @ ints[q]
        best = sorted((-s[j], j) for j in range(230) if j != q)[:5]
        want |= {(q, n + 1, j, int(-v)) for n, (v, j) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


@pytest.mark.parametrize("block", [16_384, 7])
def test_topk_counts_repeated_rows(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 16 << 20 if block > 7 else 5 * 8 * 6)
    rng = np.random.default_rng(16)
    x = rng.standard_normal((120, 6)).astype(np.float32)
    x[7] = 3 * x[0]  # the best of query 0 stands 6 times, the best of query 50 three times
    x[8] = 3 * x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 5 + [(8, x[8].tolist())] * 2
    rows += [(100, x[100].tolist())] * 2 + [(50, (-x[50]).tolist())]  # queries that repeat, with the same and with another vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    ints = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(np.int64)) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        found = sorted((-int(a @ b), j) for i, a in ints if i == q for j, b in ints if j != q)[:5]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    assert [w[2] for w in want[:5]] == [7] * 5
    assert sorted(map(tuple, topk.top_k(df).collect())) == want
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(OP7_SQL).fetchall()) == want


def test_bounds_hold():
    rng = np.random.default_rng(7)
    q, c = rng.standard_normal((20, 30)), rng.standard_normal((50, 30))
    for s in (1, 4, 16, 64):
        assert (topk.statistics(q, s) @ topk.statistics(c, s).T >= q @ c.T - 1e-9).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; tail</h1><p>First   <b>bold</b>
words&nbsp;here are several more of them.<div class="ad">Buy now</div><p>Second<br>line of the text with &lt;b&gt; in it.<aside>Side</aside>
<ul><li>point one</ul></article><section id="comments"><p>Nice post, reader says so</p></section><form><input>Search</form><footer>&copy; end</footer></body></html>"""


def test_pages(spark):
    weights = pagetext.train(spark.read.parquet(f"{DATA}/pages.parquet"))
    assert pagetext.extract(PAGE, weights) == "Head & tail\n\nFirst bold words here are several more of them.\n\nSecond line of the text with <b> in it.\n\npoint one"
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    text = pagetext.extract(plain, weights)
    assert "First bold words" in text and "Nice post" not in text and "Menu" not in text and "Buy" not in text
    for odd in (None, "", "   ", "<", "<p", "just words", "<b><i></b></p>", "<script>x", "&am &#x41 &bogus;"):
        assert isinstance(pagetext.extract(odd, weights), str)


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(31)
    for _ in range(300):
        v = rng.integers(-6, 7, int(rng.integers(0, 25))).astype(float).tolist()
        lo, hi = pagetext.best_run(v)
        assert sum(v[lo:hi]) == max([0.0, *(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))])


def test_pages_keep_what_is_no_furniture(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = pagetext.train(pages)
    for body, want in (
        ("<p title=don't>Hello words here</p><p>it's more text</p><p>end</p>", "Hello words here\n\nit's more text\n\nend"),
        ("<article><p>First of two articles.</p></article><article><p>The second is longer than the first.</p></article>", "First of two articles.\n\nThe second is longer than the first."),
        ('<article><p>Words on the</p><div class="market share"><p>market share of words</p></div></article>', "Words on the\n\nmarket share of words"),
        ("<article><p>Sum is</p><math><mi>x</mi></math><fieldset><label>and label</label></fieldset></article>", "Sum is\n\nx\n\nand label"),
        ("<article><p>Kept</p>" + '<div class="ad">Buy</div>' * 3 + "<p>and kept</p></article>", "Kept\n\nand kept"),
    ):
        assert pagetext.extract(f"<html><body><nav><a>Menu</a></nav>{body}<footer>end of page</footer></body></html>", weights) == want, body
    # the weights decide: with equal ones for all words menus and notices are in the run
    html = [r.html for r in pages.collect()]
    flat = {k: 1.0 if k[0] == "word" else -0.05 for k in weights}
    assert all(pagetext.extract(h, flat) != pagetext.extract(h, weights) for h in html)
    # articles of pages that nothing was learned from
    half = pagetext.train(pages.where("page_id % 2 = 0"))
    for r in pages.where("page_id % 2 = 1").collect():
        words = re.sub(r"<[^>]*>", " ", r.html[r.html.index("<article>") : r.html.index("</article>")])
        assert pagetext.extract(r.html, half).split() == pagetext.htmllib.unescape(words).split()
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>same</p>"), (1, "u", "<p>same</p>"), (2, None, "<p>" + "word " * 300_000)], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted((r.page_id or 0, r.n_chars) for r in pagetext.extract_pages(odd, weights).collect())
    assert got == [(0, 0), (1, 0), (1, 4), (1, 4), (2, 1_499_999)]


def test_attributes_are_read_whole(spark):
    weights = pagetext.train(spark.read.parquet(f"{DATA}/pages.parquet"))
    words = "First words of the text here are several more of them."
    page = "<html><body><article>{}</article></body></html>"
    for kept in (
        '<div style="overflow:hidden"><p>{}</p></div>', '<p aria-hidden="false">{}</p>', "<p aria-hidden=false>{}</p>", '<a title="Hidden gems">{}</a>',
        '<a href="/hidden-lake">{}</a>', '<a href="/p?id=search-tips">{}</a>', "<a href=/p?id=search-tips>{}</a>", "<a title='class=menu'>{}</a>",
        '<p data-id="search">{}</p>', '<p data-hidden>{}</p>', '<p data-role = "menu" class="text">{}</p>', '<p class="text" class="menu">{}</p>', '<p title="a > b hidden">{}</p>',
    ):
        assert pagetext.extract(page.format(kept.format(words)), weights) == words, kept
    for gone in (
        "<div hidden>{}</div>", '<div HIDDEN="">{}</div>', '<div aria-hidden="true">{}</div>', "<div class=menu>{}</div>", "<div title='x' ID = 'comments'>{}</div>",
        '<div class="a"role="navigation">{}</div>', "<div data-x=/a/b hidden>{}</div>",
    ):
        assert pagetext.extract(page.format(f"<p>{words}</p>" + gone.format("Other words")), weights) == words, gone


def test_elements_without_end_tags(spark):
    weights = pagetext.train(spark.read.parquet(f"{DATA}/pages.parquet"))
    words, more = "First words of the text here are several more of them.", "Then some other words follow it."
    page = f"<html><body><article><p>{words}</p>{{}}<p>{more}</p></article></body></html>"
    both = f"{words}\n\n{more}"
    for tag in ('<svg viewBox="0 0 1 1" />', "<math/>", "<template>", "<noscript>", "<object data=x>", "<canvas>", "<svg>", "<svg/><p></p><svg><text>no</text></svg>", "<template>" * 3):
        assert pagetext.extract(page.format(tag), weights) == both, tag
    for tag in ("<svg><text>no</text></svg>", "<noscript>no</noscript>", "<script>no</script>", "<template><p>no</p></template>"):
        assert pagetext.extract(page.format(tag), weights) == both, tag
    for tag in ("<script>", "<style>", "<textarea>", "<title>", "<script/>"):
        assert pagetext.extract(page.format(tag), weights) == words, tag


def test_linear_scores_equal_matrix():
    texts = pa.array(["", "a", "abc def", prose(200, 3), None, "é"])
    g = hashed.Grams(chars=(1, 3, 4), words=(1, 2), bits=8)
    w = np.random.default_rng(1).standard_normal((g.size, 3))
    assert np.allclose(hashed.scores(texts, g, w), hashed.matrix(texts, g) @ w, atol=1e-4)
