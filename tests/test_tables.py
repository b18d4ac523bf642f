"""Surrogate keys that hold, and a registry whose versions are switched at once."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dialoom.operators import casting
from dialoom.sources import derived as D
from dialoom.sources import scripts as S

DATA = "/root/testdata/sf0.001"
NOW = datetime(2024, 5, 6, 7, 8, 9)


def tables(spark, genders=None, status="created"):
    d = D.dialogues(spark, DATA)
    people = casting.join_gender(d, D.genders(spark)).select("book_id", "speaker", "gender").distinct()
    audio = S.character_audio(casting.cast_voice(people, *S.casting_tables(spark, D.CAST)))
    return S.relational_tables(d, D.genders(spark) if genders is None else genders, audio, NOW, status)


def test_keys_are_dense_and_hold(spark):
    t = {name: df.collect() for name, df in tables(spark).items()}
    for name, rows in t.items():
        assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1)), name
    projects, characters = {r.id for r in t["projects"]}, {r.id for r in t["characters"]}
    assert {r.project_id for r in t["characters"]} <= projects and {r.project_id for r in t["dialogues"]} == projects
    assert {r.character_id for r in t["audio_files"]} == characters
    assert len({(r.project_id, r.name) for r in t["characters"]}) == len(t["characters"])
    assert {r.status for r in t["projects"]} == {"created"} and {r.created_at for r in [*t["projects"], *t["audio_files"]]} == {NOW}
    assert {r.source for r in t["audio_files"]} == {"upload", "preset"}
    counts = {}
    for r in t["dialogues"]:
        counts[r.project_id, r.speaker] = counts.get((r.project_id, r.speaker), 0) + 1
    assert all(counts[r.project_id, r.name] == r.dialogue_count for r in t["characters"])
    by_place = sorted(t["dialogues"], key=lambda r: r.id)
    assert [(r.project_id, r.order) for r in by_place] == sorted((r.project_id, r.order) for r in by_place)


def test_a_character_with_verdicts_in_two_books_is_one_row_in_each(spark):
    g = spark.createDataFrame([(0, "user", "male", 0.9), (0, "user", "female", 0.2), (1, "user", "female", 0.9)], "book_id long, speaker string, gender string, confidence double")
    t = tables(spark, g)
    book = {r.id: r.name for r in t["projects"].collect()}
    got = {book[r.project_id]: r.gender for r in t["characters"].where("name = 'user'").collect()}
    assert got["book 0"] == "male" and got["book 1"] == "female" and set(got.values()) == {"male", "female", "unknown"}


def test_values_are_checked(spark):
    with pytest.raises(Exception, match="no status: lost"):
        tables(spark, status="lost")
    with pytest.raises(Exception, match="no status: null"):
        tables(spark, status=spark.createDataFrame([(0, "done")], "book_id long, status string"))


def test_equal_rows_have_numbers_of_their_own(spark):
    df = S.dense_ids(spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [(None,)], "v string").repartition(6), ["v"])
    rows = df.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 55)) and [r.v for r in rows] == [None] + ["a"] * 50 + ["b"] * 3
    assert S.dense_ids(spark.createDataFrame([], "v string"), ["v"]).collect() == []


def voices(spark, *rows):
    return spark.createDataFrame([(i, n, f"{n}.wav", m, seq) for i, n, m, seq in rows], "voice_id string, voice_name string, ref_audio_path string, metadata map<string,string>, seq long")


def test_registry_keeps_what_is_not_replaced(spark, tmp_path):
    root = str(tmp_path / "voices")
    assert S.read_registry(spark, root).collect() == []
    assert S.merge_voices(voices(spark, ("a", "one", {"k": "1"}, 1), ("a", "two", {"k": "2"}, 5), ("b", "bee", None, None)), root) == 1
    old = S.read_registry(spark, root)
    assert S.merge_voices(voices(spark, ("a", "three", {"j": "3"}, 0), ("c", "cee", {}, 1)).drop("seq"), root) == 2
    show = lambda df: sorted((r.voice_id, r.voice_name, r.metadata) for r in df.collect())
    assert show(S.read_registry(spark, root)) == [("a", "three", {"j": "3"}), ("b", "bee", None), ("c", "cee", {})]
    assert show(old) == [("a", "two", {"k": "2"}), ("b", "bee", None)]  # a reader keeps its version


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "voices")
    S.merge_voices(voices(spark, ("a", "one", {}, 1)), root)
    broken = spark.range(0, 8, 1, 8).select(
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("voice_id"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise("n").alias("voice_name"),
        F.lit("p").alias("ref_audio_path"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    with pytest.raises(Exception, match="lost"):
        S.write_registry(broken, root)
    assert [r.voice_id for r in S.read_registry(spark, root).collect()] == ["a"]
    (tmp_path / "voices" / "version=0000000007").mkdir()  # begun, and never ended
    assert [r.voice_id for r in S.read_registry(spark, root).collect()] == ["a"]
    assert S.merge_voices(voices(spark, ("b", "bee", {}, 1)), root) == 8
    assert sorted(r.voice_id for r in S.read_registry(spark, root).collect()) == ["a", "b"]


def test_list_files(spark, tmp_path):
    path = str(tmp_path / "list")
    S.write_voice_list(voices(spark, ("b", 'b"ee', {"k": "v"}, 1), ("a", "one", None, 2)).repartition(2), path)
    text = "".join(f.read_text() for f in sorted((tmp_path / "list").glob("part-*")))
    assert [x["voice_id"] for x in json.loads(text)] == ["a", "b"] and json.loads(text)[1]["metadata"] == {"k": "v"}
    assert sorted((r.voice_id, r.voice_name, r.metadata) for r in S.read_voices(spark, path).collect()) == [("a", "one", None), ("b", 'b"ee', {"k": "v"})]
