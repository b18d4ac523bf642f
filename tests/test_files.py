"""Many small files: written by many tasks, in one folder for each book."""

import pytest

from dialoom import catalog
from dialoom.sources import shared

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["scan_segment_files", "folder_progress", "folder_changes", "read_lines", "read_speaker_labels"])
def test_queries_deal_their_files(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(shared, "FILES_PER_TASK", 1)
    monkeypatch.setattr(catalog, "new_folder", lambda s, what: f"file://{tmp_path}/{what}")
    spark.sparkContext.setJobGroup(name, name)
    try:
        catalog.queries()[name](spark, DATA).count()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(name) for i in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    root = next(p for p in tmp_path.iterdir() if p.name in ("segments", "finished", "live", "books", "labels"))
    files, folders = [p for p in root.rglob("*") if p.is_file()], [p for p in root.rglob("*") if p.is_dir()]
    books = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
    assert 0 < len(folders) <= books <= len(files) + books - len(folders)
    most = max(s.numTasks for s in stages if s)
    assert most > len(files) // 3  # live folders are filled in two rounds


def test_lines_in_order_and_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "FILES_PER_TASK", 3)
    rows = [(f"f{i % 4}", f"{i % 12}.txt", None if n == 5 else f"é{n}", n) for i in range(12) for n in range(40)]
    df = spark.createDataFrame(rows, "folder string, name string, value string, n long").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a file lies in several batches
    try:
        for _ in range(2):  # and again over what is there
            shared.write_files(df, 12, f"file://{tmp_path}/out", ["n"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = "".join("\n" if n == 5 else f"é{n}\n" for n in range(40)).encode()
    found = sorted((tmp_path / "out").rglob("*.txt"))
    assert len(found) == 12 and all(p.read_bytes() == want for p in found)
