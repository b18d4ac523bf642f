"""Literal lines with known results, files, and independence of the input's order."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import audio, casting, context, parsing, stats, timeline
from dialoom.sources import derived as D
from dialoom.sources import scripts as S

CASES = [
    ("「你好」——罗伦斯", "dialogue", "你好", "罗伦斯"),
    ("罗伦斯：「你好」", "dialogue", "你好", "罗伦斯"),
    ("「你好」", "dialogue", "你好", ""),
    ("这是一段叙述性文字。", "narrative", "这是一段叙述性文字。", ""),
    ("「a」他说。", "dialogue", "a", "他说。"),
    ("「a」——", "dialogue", "a", "—"),
    ("「a」b「c」", "dialogue", "a", "b「c」"),
    ("甲：「x『y』」", "dialogue", "x『y』", "甲"),
    ("甲：『x』", "dialogue", "x』", "甲"),
    ("前「p」后「q」", "dialogue", "p", ""),
    ("他说：「你好」然后走了", "dialogue", "你好」然后走了", "他说"),
    ("第三章", "chapter", "第三章", ""),
    ("第三章 雨", "chapter", "第三章 雨", ""),
    ("序章", "chapter", "序章", ""),
    ("Chapter 3: X", "chapter", "Chapter 3: X", ""),
    ("part 2", "chapter", "part 2", ""),
    ("第三章开始", "narrative", "第三章开始", ""),
    ("短句。", "narrative", "短句。", ""),
    ("   ", "blank", "", ""),
    ("　「」　", "dialogue", "", ""),
    (None, "blank", "", ""),
]


def lines_of(spark, texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "book_id long, line_no long, line string")


def test_literal_lines(spark):
    got = parsing.classify_lines(lines_of(spark, [c[0] for c in CASES])).orderBy("line_no").collect()
    assert [(r.kind, r.text, r.speaker) for r in got] == [c[1:] for c in CASES]


def test_strict_trailing_speaker(spark):
    got = parsing.classify_lines(lines_of(spark, ["「a」他说。", "「a」——甲"]), strict=True).orderBy("line_no").collect()
    assert [(r.text, r.speaker) for r in got] == [("a", ""), ("a", "甲")]


def test_order_of_input_does_not_matter(spark):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, D.dialogues(spark, d).collect()))
    lines, labels = D.lines(spark, d), D.labels(spark, d)
    got = parsing.dialogue_table(lines.orderBy(F.rand(3)).repartition(5), labels.orderBy(F.rand(4)).repartition(3))
    assert sorted(map(tuple, got.collect())) == want


def test_line_ends(spark):
    df = spark.createDataFrame([(1, "a\r\nb\x0bc d\n"), (2, ""), (3, "x\n\n")], "book_id long, value string")
    got = S.numbered_lines(df).orderBy("book_id", "line_no").collect()
    assert [(r.book_id, r.line) for r in got] == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (3, "x"), (3, "")]


@pytest.mark.parametrize("paren,want", [("()", "(欢快活泼，温柔)"), ("（）", "（欢快活泼，温柔）"), ("", "欢快活泼，温柔")])
def test_style_prefix(spark, paren, want):
    df = spark.createDataFrame([("happy", "gentle"), ("calm", None), ("x", "y")], "e string, t string")
    got = [r[0] for r in df.select(T.style_prefix(F.col("e"), F.col("t"), paren)).collect()]
    assert got[0] == want and "平静冷静" in got[1] and got[2] == ""


def test_durations(spark):
    df = spark.createDataFrame([(59.9,), (60.0,), (3600.0,)], "x double")
    assert [r[0] for r in df.select(T.format_duration(F.col("x"))).collect()] == ["59.9s", "1.0min", "1.0h"]


def test_regions(spark):
    values = [0, 0.5, 0.5, 0, 0, 0.5, 0, 0, 0, 0, 0, 0, 0.6, 0.6]
    frames = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "clip_id long, frame_idx long, rms double")
    regions = audio.voiced_regions(frames)
    assert sorted((r.start_ms, r.end_ms) for r in regions.collect()) == [(100, 300), (500, 600), (1200, 1300)]
    assert sorted((r.start_ms, r.end_ms) for r in audio.merge_regions(regions).collect()) == [(100, 600), (1200, 1300)]


def test_timeline_ends_at_sum(spark):
    t = timeline.splice_timeline(D.segments(spark, "/root/testdata/sf0.001"))
    got = t.groupBy("book_id").agg(F.max("end_ms").alias("e"), F.sum(F.col("gap_ms") + F.col("duration_ms")).alias("s")).where("e <> s").count()
    assert got == 0


def test_overlapping_keywords(spark):
    got = context.keyword_search(lines_of(spark, ["女店员", "店员", "x"]), ["店员", "女店员"], limit=1).collect()
    assert sorted((r.keyword, r.line_no, r.total, r.truncated) for r in got) == [("女店员", 1, 1, False), ("店员", 1, 2, True)]


def test_lines_are_shown_stripped(spark):
    lines = lines_of(spark, ["  　甲 " + "x" * 200 + " 「q」 ", "甲", "乙"])
    got = context.keyword_search(lines, ["甲", "丙"])
    first = min(got.collect(), key=lambda r: r.line_no)
    assert first.line == ("甲 " + "x" * 200)[:120] and first.total == 2
    asked = spark.createDataFrame([("甲", 1), ("丙", 1)], "keyword string, book_id long")
    shown = {r.keyword: r.output for r in context.render_search(context.keyword_search(lines, ["甲", "丙"], limit=1), asked).collect()}
    assert shown["甲"].startswith("Found 2 matches (showing 1 of 2):\nLine 1: 甲 xx") and shown["丙"] == "Found 0 matches\nNo matches found"
    mention = context.mention_dialogues(lines, ["甲"]).collect()
    assert [(r.line_no, len(r.line)) for r in mention] == [(1, 120)]


def test_ranges_of_unknown_books_are_empty(spark):
    asked = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (1, 3, 2), (9, 1, 5)], "book_id long, start long, end long")
    got = context.read_range(lines_of(spark, [" a", "b ", "c"]), asked).orderBy("book_id", "start").collect()
    assert [(r.book_id, r.text, r.truncated) for r in got] == [(1, "1: a\n2: b", False)] * 2 + [(1, "", False), (9, "", False)]


def test_several_verdicts_double_no_dialogue(spark):
    d = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "a")], "book_id long, ord long, speaker string")
    g = spark.createDataFrame([(1, "a", "female", 0.9), (1, "a", "male", 0.2), (2, "a", "unknown", 0.9)], "book_id long, speaker string, gender string, confidence double")
    assert sorted((r.book_id, r.gender) for r in casting.join_gender(d, g).collect()) == [(1, "female"), (2, "male"), (3, "male")]


def test_fallback_audio_and_missing_references(spark):
    df = spark.createDataFrame([(None, "male"), ("旁白", "male"), ("x", "male"), ("y", "female"), ("z", "female")], "speaker string, gender string")
    cast, default = S.casting_tables(spark, {"characters": {"z": "z.wav"}, "default_audio": {"female": "f.wav"}})
    got = {(r.speaker, r.ref_audio) for r in casting.cast_voice(df, cast, default).collect()}
    assert got == {(None, "narrator.wav"), ("旁白", "narrator.wav"), ("x", "male.wav"), ("y", "f.wav"), ("z", "z.wav")}
    clones = spark.createDataFrame([("x", "a.wav"), ("z", "gone.wav")], "speaker string, ref_audio string")
    audio_files = spark.createDataFrame([("a.wav",)], "path string")
    engines = {r.speaker: (r.engine, r.voice) for r in casting.assign_engine(df, clones, audio_files).collect()}
    assert engines["x"] == ("clone", "a.wav") and engines["z"] == ("preset", "female_voice") and engines["旁白"] == ("preset", "male_voice")


def test_listing_of_missing_speakers(spark):
    d = spark.createDataFrame([(1, 0, None, "p"), (1, 1, "", "q"), (1, 2, "a", "r")], "book_id long, ord long, speaker string, text string")
    got = [r.listing for r in S.debug_listing(d, 0, 3).orderBy("row").collect()]
    assert got == ["对话范围: 0-3", "共 3 条对话, 1 个角色", "=" * 60, "", "[0] ?: p", "[1] : q", "[2] a: r"]


def test_slices_and_modes(spark):
    d = D.dialogues(spark, "/root/testdata/sf0.001")
    assert stats.slice_dialogues(d, limit=2).where("ord > 1").count() == 0 and stats.slice_dialogues(d, limit=2).count() > 0
    assert stats.needs_emotion(d, "all").count() == d.count()


def test_results_files_of_both_shapes(spark, tmp_path):
    row = {"emotion": "calm", "tone": "soft", "confidence": 0.5, "evidence": "e"}
    for name, body in (("a", {"results": {"3": row}}), ("b", {"total": 1, "results": [{"index": 4, **row}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    got = S.read_emotion_results(spark, str(tmp_path)).collect()
    assert sorted((r.ord, r.emotion, r.evidence) for r in got) == [(3, "calm", "e"), (4, "calm", "e")]


def test_voices_and_segment_files(spark, tmp_path):
    (tmp_path / "00007.wav").write_bytes(b"abc")
    (tmp_path / "x.txt").write_bytes(b"abc")
    got = S.scan_segment_files(spark, str(tmp_path)).collect()
    assert [(r.ord, r.length) for r in got] == [(7, 3)]
    (tmp_path / "v.json").write_text(json.dumps([{"voice_id": "a", "voice_name": "n", "ref_audio_path": "p", "metadata": {"k": "v"}}]))
    assert S.read_voices(spark, str(tmp_path / "v.json")).first().metadata == {"k": "v"}
