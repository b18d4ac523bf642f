"""Listings of a live folder in rounds."""

import os

import pytest
from pyspark.sql import functions as F

from dialoom.plans import jobs
from dialoom.sources import listing, scripts

NUMBER, BOOK = r"/(\d+)[^/]*\.wav$", r"/book(\d+)/"


def put(root, name, content, at):
    file = root / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(content)
    os.utime(file, (at, at))


def seen(df):
    return sorted((r.path.split("/live/")[1], r.ord, r.length, r.gone) for r in df.collect())


def test_rounds_return_what_differs(spark, tmp_path):
    live, manifest = tmp_path / "live", str(tmp_path / "manifest")
    put(live, "book1/00000.wav", b"abc", 100)
    put(live, "book1/00001_x.wav", b"", 110)
    put(live, "book2/00000.wav", b"abcd", 120)
    put(live, "book2/notes.txt", b"no", 120)
    first = listing.list_changes(spark, str(live), manifest, NUMBER)
    want = [("book1/00000.wav", 0, 3, False), ("book2/00000.wav", 0, 4, False)]
    assert seen(first) == want
    assert seen(listing.list_changes(spark, str(live), manifest, NUMBER)) == []
    put(live, "book1/00001_x.wav", b"xyz", 200)  # filled
    put(live, "book2/00000.wav", b"abce", 210)  # written again, as long as before
    put(live, "book2/00001.wav", b"n", 220)
    (live / "book1/00000.wav").unlink()
    second = listing.list_changes(spark, str(live), manifest, NUMBER)
    assert seen(second) == [("book1/00000.wav", 0, 3, True), ("book1/00001_x.wav", 1, 3, False), ("book2/00000.wav", 0, 4, False), ("book2/00001.wav", 1, 1, False)]
    assert seen(first) == want  # a round that was read stays
    full = scripts.scan_segment_files(spark, str(live), NUMBER)
    assert sorted(map(tuple, listing.read_manifest(spark, manifest).select("path", "ord", "length", "modified").collect())) == sorted(map(tuple, full.collect()))
    put(live, "book1/00000.wav", b"abc", 100)  # back, as it was
    assert seen(listing.list_changes(spark, str(live), manifest, NUMBER)) == want[:1]


def test_a_round_that_failed_is_made_up_for(spark, tmp_path):
    live, manifest = tmp_path / "live", tmp_path / "manifest"
    assert listing.read_manifest(spark, str(manifest)).count() == 0
    put(live, "book1/00000.wav", b"abc", 100)
    (manifest / "version=0000000003").mkdir(parents=True)  # begun, and never ended
    assert len(seen(listing.list_changes(spark, str(live), str(manifest)))) == 1
    assert seen(listing.list_changes(spark, str(live), str(manifest))) == []


@pytest.mark.parametrize("times", [1, 2])
def test_the_report_equals_that_of_the_full_listing(spark, tmp_path, times):
    live, manifest = tmp_path / "live", str(tmp_path / "manifest")
    totals = spark.createDataFrame([(1, 5), (2, 4)], "book_id long, total long")
    for n in range(times):
        for book in (1, 2):
            put(live, f"book{book}/{n:05d}.wav", b"abc" * n, 1000 + 10 * n)
            put(live, f"book{book}/{n + 2:05d}.wav", b"abc", 1005 + 10 * n)
        stored = jobs.folder_progress(spark, str(live), totals, NUMBER, BOOK, 2000, manifest)
        full = jobs.folder_progress(spark, str(live), totals, NUMBER, BOOK, 2000)
        assert stored.orderBy("book_id").collect() == full.orderBy("book_id").collect()
        assert full.select(F.sum("done")).first()[0] == (2, 6)[n]
