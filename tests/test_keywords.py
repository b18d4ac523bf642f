"""Keywords from a table and tool calls against plain programs."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.operators import context, keywords
from dialoom.sources import derived as D

DATA = "/root/testdata/sf0.001"
LINES = ["他说：「你好」", "「赫萝」笑了", "  abcabc  ", "", None, "Ünï 🙂🙂 codé", "aaaa", "x" * 3000 + "needle" + "y" * 3000, "赫", "「a」 and 「赫萝」"]


def lines_of(spark):
    return spark.createDataFrame([(b, i + 1, t) for b in (1, 2) for i, t in enumerate(LINES)], "book_id long, line_no long, line string").repartition(3)


def words_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "keyword string")


WORDS = ["赫萝", "赫", "abc", "bca", "a", "aa", "aaaaa", "🙂", "🙂🙂 c", "needle", "codé", "", "not there", None, "abc", "「"]


@pytest.mark.parametrize("most", [0, 500_000])  # joined by a shuffle, and broadcast
def test_found_as_by_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "BROADCAST_KEYWORDS", most)
    got = keywords.find_keywords(lines_of(spark), words_of(spark, WORDS))
    want = sorted((b, i + 1, w) for b in (1, 2) for i, t in enumerate(LINES) if t is not None for w in set(WORDS) - {None} if w in t)
    assert sorted((r.book_id, r.line_no, r.keyword) for r in got.collect()) == want
    own = spark.createDataFrame([(1, "a"), (2, "赫"), (3, "a")], "book_id long, keyword string")
    got = keywords.find_keywords(lines_of(spark), own)
    want = sorted((b, i + 1, w) for b, w in ((1, "a"), (2, "赫")) for i, t in enumerate(LINES) if t is not None and w in t)
    assert sorted((r.book_id, r.line_no, r.keyword) for r in got.collect()) == want
    assert keywords.find_keywords(lines_of(spark), words_of(spark, [])).collect() == []


def test_tables_equal_lists(spark):
    lines, words = D.lines(spark, DATA).cache(), ["user", "the", "an", "k"]
    table = words_of(spark, words)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(keywords.search_table(lines, table, 3)) == rows(context.keyword_search(lines, words, 3))
    assert rows(keywords.mention_table(lines, table, 2)) == rows(context.mention_dialogues(lines, words, 2))
    d = D.dialogues(spark, DATA).cache()
    assert rows(keywords.locate_table(d, table)) == rows(context.locate_text(d, words))


def test_keywords_are_not_part_of_the_plan(spark):
    lines = lines_of(spark)
    found = keywords.find_keywords(lines, words_of(spark, [f"name{i}" for i in range(300)]))
    assert "name299" not in found._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0]


def answer(name, args, tools):
    """One call, as a program over the lines of a book."""
    lines = [x or "" for x in LINES]
    if name not in tools:
        return f"Unknown tool: {name}"
    limit = max(int(args.get("limit", 20)), 1)
    if name == "read_lines":
        start = int(args.get("start_line", 1))
        end = int(args.get("end_line", start + 100))
        some = [f"{i + 1}: {lines[i].strip()}" for i in range(max(start, 1) - 1, min(end, len(lines)))]
        return "\n".join(some) or "No lines in range"
    word = args.get("keyword" if name == "search_novel" else "character_name", "")
    if name == "search_novel":
        hits = [(i + 1, x.strip()[:120]) for i, x in enumerate(LINES) if x is not None and word in x]
    else:
        hits = [(i + 1, x.strip()[:120]) for i, x in enumerate(LINES) if x is not None and word in x.strip() and "「" in x]
    shown = [f"Line {i}: {x}" for i, x in hits[:limit]]
    if name == "get_dialogues":
        return f"Found {len(shown)} dialogues:\n" + "\n".join(shown) if shown else f"No dialogues found for '{word}'"
    head = f"Found {len(hits)} matches" + (f" (showing {len(shown)} of {len(hits)})" if len(hits) > len(shown) else "")
    return head + (":\n" + "\n".join(shown) if shown else "\nNo matches found")


@pytest.mark.parametrize("tools", [keywords.GENDER_TOOLS, keywords.EMOTION_TOOLS])
def test_calls(spark, tools):
    asked = [("search_novel", {"keyword": w, "limit": n}) for w in ("a", "赫", "zzz") for n in (1, 2, 50, 0)]
    asked += [("search_novel", {}), ("search_novel", {"keyword": "a"}), ("get_dialogues", {"character_name": "赫"}), ("get_dialogues", {"character_name": "赫", "limit": 1}), ("get_dialogues", {"character_name": "nobody"}), ("get_dialogues", {})]
    asked += [("read_lines", {}), ("read_lines", {"start_line": 3}), ("read_lines", {"start_line": 8, "end_line": 99}), ("read_lines", {"start_line": 5, "end_line": 2}), ("read_lines", {"start_line": -4, "end_line": 1}), ("other", {"x": 1})]
    rows = [(b, i, n, json.dumps(a)) for b in (1, 2) for i, (n, a) in enumerate(asked)]
    calls = spark.createDataFrame([*rows, (1, 900, "search_novel", "{no json"), (1, 901, "read_lines", None), (7, 902, "search_novel", "{}"), (1, 903, None, "{}")], "book_id long, call_id long, name string, arguments string")
    got = {(r.book_id, r.call_id): r.output for r in keywords.answer_calls(calls, lines_of(spark), tools).collect()}
    want = {(b, i): answer(n, a, tools) for b in (1, 2) for i, (n, a) in enumerate(asked)}
    want |= {(1, 900): answer("search_novel", {}, tools), (1, 901): answer("read_lines", {}, tools), (7, 902): "Found 0 matches\nNo matches found", (1, 903): "Unknown tool: "}
    assert got == want
    assert keywords.answer_calls(calls, lines_of(spark), tools).count() == calls.count()


def test_nothing_asked(spark):
    calls = spark.createDataFrame([], "book_id long, call_id long, name string, arguments string")
    assert keywords.answer_calls(calls, lines_of(spark)).collect() == []
    assert keywords.search_table(lines_of(spark), words_of(spark, ["zz"]).where(F.lit(False))).collect() == []


@pytest.mark.parametrize("exact", [0, 1000])  # slots alone, and grams too
def test_only_grams_of_keywords_become_rows(spark, monkeypatch, exact):
    monkeypatch.setattr(keywords, "EXACT_GRAMS", exact)
    monkeypatch.setattr(keywords, "STEP", 64)  # keywords lie over borders of blocks
    made = []
    plain = keywords._with_grams

    def watched(df, text, lengths, known):
        out = plain(df, text, lengths, known)
        if known is not None:
            made.append(out)
        return out

    monkeypatch.setattr(keywords, "_with_grams", watched)
    words = ["a needle in it", "a needle in hay", "赫萝与罗伦斯", "éa", "zq", "sevenby", "eightbyt", "nine bytes"]
    texts = [f"{i:05d} " * 40 + words[i % 8] + f" {i:05d}" * 40 for i in range(80)] + ["a needle in", "", "éb"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "book_id long, line_no long, line string").repartition(3)
    got = keywords.find_keywords(lines, words_of(spark, words))
    assert sorted((r.line_no, r.keyword) for r in got.collect()) == sorted((i, w) for i, t in enumerate(texts) for w in words if w in t)
    rows = made[0].select(F.sum(F.size("grams"))).first()[0]
    assert 80 <= rows <= 120  # of 40,000 places


def shuffled_rows(spark):
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(60_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lines_are_shuffled_and_not_their_hits(spark):
    words = [f"w{i}w" for i in range(60)]
    lines = spark.createDataFrame([(i // 50, i, " ".join(words[i % 3 :])) for i in range(400)], "book_id long, line_no long, line string").repartition(3).cache()
    table = words_of(spark, words).cache()
    assert lines.count() + table.count() == 460
    before = shuffled_rows(spark)
    assert keywords.search_table(lines, table, 20).where("truncated").count() == 8 * 59 * 20  # the first keyword has 17 hits a book
    assert shuffled_rows(spark) - before < 3000  # of 23,600 hits


@pytest.mark.parametrize(("width", "held"), [(1 << 16, 1 << 20), (1 << 16, 5), (4, 1 << 20), (4, 3), (1, 1)])
def test_first_hits_of_long_books(spark, monkeypatch, width, held):
    monkeypatch.setattr(keywords, "HELD_HITS", held)
    texts = ["ab b c", "a", "", None, "bb abc", "c a b", "no", "a long keyword b", " b a "]
    rows = [(b, i + b, texts[(i * b + i // 7) % 9]) for b, n in ((1, 40), (2, 3), (3, 25), (5, 1)) for i in range(n)] + [(None, i, "a b") for i in range(6)] + [(8, None, "b"), (8, 2, "a b")]
    lines = spark.createDataFrame(rows, "book_id long, line_no long, line string").repartition(5)
    words = ["a", "b", "ab", "c", "long keyword", "", "zz"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in keywords.search_table(lines, words_of(spark, words), 3, width=width).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for w in words:
        for book in (1, 2, 3, 5, 8, None):
            hits = sorted(((-1 if i is None else i), i, t.strip()) for b, i, t in rows if b == book and t is not None and w in t)
            want += [(w, book, i, t, len(hits), len(hits) > 3) for _, i, t in hits[:3]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
