"""Scans through books and clips that lie in many ranges, and files in many splits, against plain programs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.operators import audio, context, parsing, scan, stats, timeline
from dialoom.sources import derived as D
from dialoom.sources import lines as L
from dialoom.sources import scripts as S

DATA = "/root/testdata/sf0.001"
WIDTHS = [1, 3, 7, 65_536]


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("width", WIDTHS)
def test_scan_equals_a_loop(spark, width):
    rng = np.random.default_rng(width)
    rows = []
    for key in range(4):
        places = np.sort(rng.choice(60, rng.integers(0, 40), replace=False)) - 20
        rows += [(key, int(p), int(rng.integers(0, 9)) if rng.random() < 0.7 else None) for p in places]
    df = spark.createDataFrame([*rows, (None, 3, 1), (2, None, 1)], "k long, at long, v long").repartition(3)
    v = F.col("v")
    got = scan.scan(df, "k", ["at"], sums={"total": v}, latest={"last": v}, before={"up": v}, after={"down": F.col("at")}, width=width)
    want, state = [], {}
    for i, (k, at, x) in enumerate(rows):
        total, last, up = state.get(k, (0, None, None))
        total, last = total + (x or 0), last if x is None else x
        down = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == k else None
        want.append((at, down, k, last, total, up, x))
        state[k] = (total, last, x)
    assert rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [3])
def test_books_do_not_depend_on_ranges(spark, width):
    lines, labels = D.lines(spark, DATA).cache(), D.labels(spark, DATA).cache()
    parsed = parsing.classify_lines(lines)
    d = D.dialogues(spark, DATA).cache()
    for cut, whole in (
        (parsing.dialogue_table(lines, labels, width=width), d),
        (parsing.fill_chapter(parsed, width), parsing.fill_chapter(parsed)),
        (parsing.align_labels(parsed, labels, width=width), parsing.align_labels(parsed, labels)),
        (parsing.align_quotes(lines, labels, width), parsing.align_quotes(lines, labels)),
        (timeline.splice_timeline(D.segments(spark, DATA), width=width), timeline.splice_timeline(D.segments(spark, DATA))),
        (context.context_window(d, lines, 4, width=width), context.context_window(d, lines, 4)),
        (context.context_window(d.where("ord % 7 = 2"), lines, 4, few=True, width=width), context.context_window(d.where("ord % 7 = 2"), lines, 4)),
        (context.emotion_cues(d, "he", width), context.emotion_cues(d, "he")),
        (stats.first_cooccurrence(d, "user", "guest", 5, width), stats.first_cooccurrence(d, "user", "guest", 5)),
        (stats.running_progress(D.run_log(spark, DATA), width), stats.running_progress(D.run_log(spark, DATA))),
    ):
        assert rows_of(cut) == rows_of(whole)


def plain_regions(values, threshold, frame_ms):
    """Regions of one clip: [(frame, rms)] in order."""
    out, start = [], None
    for i, (at, v) in enumerate(values):
        if v > threshold and start is None:
            start = at
        if v <= threshold and start is not None:
            out.append((start * frame_ms, at * frame_ms))
            start = None
        elif i == len(values) - 1 and start is not None:
            out.append((start * frame_ms, at * frame_ms))
    return out


def plain_merged(regions, gap):
    out = []
    for s, e in regions:
        if out and s - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("width", [1, 5, 64, 65_536])
def test_clips_in_ranges(spark, width):
    """Regions over many ranges, merging across borders, gaps in the numbering, a clip without sound."""
    rng = np.random.default_rng(width)
    clips = {
        1: [(i, 1.0) for i in range(100)], 2: [(i, 0.0) for i in range(50)], 3: [(i * 3, float(x)) for i, x in enumerate(rng.integers(0, 2, 150))],
        4: [(i, float(x)) for i, x in enumerate(rng.random(200))], 5: [(7, 1.0)], 6: [(i, float(i % 20 < 17)) for i in range(130)],
    }
    frames = spark.createDataFrame([(c, i, v) for c, rows in clips.items() for i, v in rows], "clip_id long, frame_idx long, rms double").repartition(4)
    regions = audio.voiced_regions(frames, 0.5, 100, width)
    want = {c: plain_regions(rows, 0.5, 100) for c, rows in clips.items()}
    assert sorted(map(tuple, regions.collect())) == sorted((c, s, e) for c, r in want.items() for s, e in r)
    merged = audio.merge_regions(regions, 300, width * 100)
    joined = {c: plain_merged(r, 300) for c, r in want.items()}
    assert sorted(map(tuple, merged.collect())) == sorted((c, s, e) for c, r in joined.items() for s, e in r)
    plan, at = [], {}
    for c, r in joined.items():
        for s, e in r:
            begin = at.get(c, 0)
            if begin < 4000:
                plan.append((c, s, e, begin, min(begin + e - s, 4000)))
            at[c] = begin + e - s + 100
    assert sorted(map(tuple, audio.clip_plan(merged, 100, 4000, width * 100).collect())) == sorted(plan)


@pytest.mark.parametrize("width", [4, 9, 65_536])
def test_frames_in_ranges(spark, width):
    rng = np.random.default_rng(1)
    samples = {1: rng.random(777), 2: rng.random(3), 3: rng.random(64)}
    df = spark.createDataFrame([(c, i, float(v)) for c, x in samples.items() for i, v in enumerate(x)], "clip_id long, sample_idx long, v double")
    got = {(r.clip_id, r.frame_idx): r.rms for r in audio.frame_rms(df, 16, 4, width).collect()}
    want = {}
    for c, x in samples.items():
        padded = np.pad(x, (8, 24))
        for h in range(len(x) // 4 + 1):
            want[(c, h)] = np.sqrt((padded[4 * h : 4 * h + 16] ** 2).sum() / 16)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_window_has_a_whole_book_or_clip(spark):
    """Rows are partitioned by ranges too, wherever there is one row for each line, segment or frame."""
    d = D.dialogues(spark, DATA)
    for df in (d, timeline.splice_timeline(D.segments(spark, DATA)), context.context_window(d, D.lines(spark, DATA)), audio.clip_plan(audio.merge_regions(audio.voiced_regions(D.frames(spark, DATA))))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x and "windowspecdefinition(" in x]
        assert windows and any("_range" in w for w in windows)
        for w in windows:
            spec = w.split("windowspecdefinition(")[1]
            # by book or clip alone only what is one row a range, and the tables that stand for files here
            assert "_range" in spec or "turn#" in spec or "ts#" in spec or "user_id" in spec


ENDS = ["\n", "\r\n", "\r", "\x0b", " ", "\x85", "\n\n", "\r\n\r\n"]


@pytest.mark.parametrize("split", ["40", "1000", "100m"])
def test_files_in_splits(spark, tmp_path, split):
    rng = random.Random(5)
    want = {}
    for b in range(15):
        ends = [ENDS[:1], ENDS[:2], ENDS][b % 3]
        text = "".join(f"zeile {i} é日" * rng.randint(0, 3) + rng.choice(ends) for i in range(rng.choice([0, 1, 5, 150])))
        text = ("﻿" if b % 7 == 3 else "") + text + ["", "rest", "x\x0b", "\r", "\x0b"][b % 5]
        (tmp_path / f"book_id={b}").mkdir()
        (tmp_path / f"book_id={b}" / "text.txt").write_bytes(text.encode())
        want |= {(b, i + 1): x for i, x in enumerate(text.splitlines())}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = L.read_lines(spark, str(tmp_path))
        assert {(r.book_id, r.line_no): r.line for r in df.collect()} == want
        whole = spark.read.schema("value string, book_id long").text(str(tmp_path), wholetext=True)
        # the reader of whole texts keeps the mark of byte order too
        assert {(r.book_id, r.line_no): r.line for r in L.numbered_lines(whole).collect()} == want
        labels = {}
        for (b, _), line in sorted(want.items()):
            if line.strip():
                labels.setdefault(b, []).append(line.strip())
        got = {(r.book_id, r.ord): r.label for r in S.read_speaker_labels(spark, str(tmp_path)).collect()}
        assert got == {(b, i): x for b, names in labels.items() for i, x in enumerate(names)}
        assert (df.rdd.getNumPartitions() > 20) == (split == "40")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_that_change_between_the_passes_fail(spark, tmp_path):
    (tmp_path / "book_id=1").mkdir()
    file = tmp_path / "book_id=1" / "a.txt"
    file.write_text("a\nb\n")
    df = L.read_lines(spark, str(tmp_path))
    assert df.count() == 2
    file.write_text("a\nb\nc\nd\n")
    with pytest.raises(Exception, match="changed|FileNotFound|not exist"):
        df.collect()
    assert L.read_lines(spark, str(tmp_path)).count() == 4
