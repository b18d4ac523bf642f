"""The pipeline's stages on a small corpus, each against what a plain program finds on its input."""

from collections import Counter

import numpy as np
from test_operators import WORD, groups, prose, removed

import corpus_pipeline
from dialoom.llm import minhash, packing, quality, tokens
from dialoom.llm.queries import tokenizer_path


def corpus():
    """Prose, near and exact copies, a passage that many share, junk, and awkward rows."""
    rng = np.random.default_rng(77)
    passage = prose(60, 900, 10**6)
    rows = []
    for i in range(40):
        text = prose(int(rng.integers(40, 200)), i, 10**6)
        if i % 4 == 0:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 3}"))
    for i in range(8):
        words = rows[i][1].split()
        words[i] = "other"
        rows.append((100 + i, " ".join(words) if i % 2 else rows[i][1], "en", "s1"))
    rows += [(200 + i, "### $$$ *** " * 12 + "%% " * i, "en", "s2") for i in range(10)] + [(300, None, None, None), (301, "", "en", None), (302, "short text", "en", "s0")]
    return [(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows]


def test_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    docs = spark.createDataFrame(corpus(), schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] < 200), 0) for r in corpus()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, sf_dir = dict(corpus_pipeline.STAGES), str(tmp_path)

    def run(name, docs):
        out = corpus_pipeline.save(stages[name](spark, docs, sf_dir), "stage")
        return out, sorted(map(tuple, out.collect()), key=repr)

    before = sorted(map(tuple, docs.collect()), key=repr)
    good, rows = run("quality rules", docs)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert rows == [r for r in before if verdict[r[0]]]
    assert {r[0] for r in rows} == {r[0] for r in before if r[0] < 200}

    unique, kept = run("MinHash near-dedup", good)
    heads = {c for _, _, c in groups([r[:2] for r in rows], minhash.NearDup(words=5, percent=80))}
    assert kept == [r for r in rows if r[0] in heads] and len(kept) == 40

    plain, cut = run("suffix-array dedup", unique)
    want = removed([r[1].encode() for r in kept])
    assert [r[0] for r in cut] == [r[0] for r in kept]
    for r, old, w in zip(cut, kept, want):
        assert len(r[1].encode()) == w[0] - w[1] and r[4] == len(r[1]) and r[2:4] == old[2:4]
    assert sum(w[1] for w in want) > 0

    mixed, taken = run("source mixing", plain)
    copies, size = Counter(taken), Counter()
    for r in cut:
        size[r[3]] += len(WORD.findall(r[1]))
    assert set(copies) <= set(cut) and max(copies.values()) <= 2
    assert abs(sum(len(WORD.findall(r[1])) * n for r, n in copies.items()) - 1.5 * sum(size.values())) < 3 * 200

    _, pieces = run("packing", mixed)
    encode, expected = tokens.PieceEncoder(tokenizer_path("word_bpe_49k.json")).encode, Counter()
    for r in taken:
        n = len(encode(r[1])) + 1
        expected.update((r[0], s, min(packing.WINDOW, n - s)) for s in range(0, n, packing.WINDOW))
    assert Counter(p[:3] for p in pieces) == expected

    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((p[0], p[1], p[2], p[3]) for p in pieces)


def test_stages_take_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
