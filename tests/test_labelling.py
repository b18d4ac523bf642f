"""Labelling that fails half way and is taken up again."""

import os

import pytest

from dialoom.operators import labeling

KEYS = ["book_id", "ord"]


def asked_of(spark, n, text="line {}"):
    return spark.createDataFrame([(1, i, text.format(i)) for i in range(n)], "book_id long, ord long, request string")


def model(log, broken=None):
    """Writes each call to a file of its own process; at the request ``broken`` the worker dies."""

    def make():
        def answer(request):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(request + "\n")
            if request == broken:
                os._exit(1)
            if request.endswith("7"):
                raise ValueError("no answer")
            return request.upper()

        return answer

    return make


def calls(log):
    return sorted(line for name in os.listdir(log) for line in (log / name).read_text().splitlines())


def test_a_failed_run_is_taken_up(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    asked = asked_of(spark, 120)
    with pytest.raises(Exception):
        labeling.label_resumably(asked, model(log, "line 100"), store, KEYS, per_task=1)
    first = calls(log)
    kept = {r.ord for r in labeling.stored_answers(spark, store, KEYS).collect()}
    assert "line 100" in first and len(kept) >= 20
    out = labeling.label_resumably(asked, model(log), store, KEYS, per_task=1)
    assert {(r.ord, r.reply) for r in out.collect()} == {(i, "Error: no answer" if i % 10 == 7 else f"LINE {i}") for i in range(120)}
    second = calls(log)
    # what was answered isn't asked again; only tasks that were cut off are, of which each had one request
    for i in kept:
        assert second.count(f"line {i}") == 1
    assert len(second) - 120 <= 8
    labeling.label_resumably(asked, model(log), store, KEYS)
    assert calls(log) == second


def test_changed_requests_errors_and_force(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    labeling.label_resumably(asked_of(spark, 10), model(log), store, KEYS)
    labeling.label_resumably(asked_of(spark, 10, "new {}").union(asked_of(spark, 12)).where("ord > 8"), model(log), store, KEYS)
    assert calls(log) == sorted([*(f"line {i}" for i in range(12)), "new 9"])
    labeling.label_resumably(asked_of(spark, 10), model(log), store, KEYS, retry_errors=True)
    assert calls(log).count("line 7") == 2
    out = labeling.label_resumably(asked_of(spark, 3), model(log), store, KEYS, force=True)
    assert sorted(r.ord for r in out.collect()) == [0, 1, 2]
    assert [calls(log).count(f"line {i}") for i in range(4)] == [2, 2, 2, 1]
    # the new generation only knows what was asked in it
    labeling.label_resumably(asked_of(spark, 5), model(log), store, KEYS)
    assert [calls(log).count(f"line {i}") for i in range(5)] == [2, 2, 2, 2, 2]


def test_awkward_requests(spark, tmp_path):
    rows = [(1, 1, "a"), (1, 1, "a"), (None, 2, "b"), (1, 3, None), (2, 4, "")]
    df = spark.createDataFrame(rows, "book_id long, ord long, request string")
    out = labeling.label_resumably(df, lambda: str.upper, str(tmp_path / "s"), KEYS).collect()
    assert sorted(map(tuple, out)) == [(1, 1, "A", "ok"), (2, 4, "", "ok")]
    none = labeling.label_resumably(df.limit(0), lambda: str.upper, str(tmp_path / "t"), KEYS)
    assert none.collect() == [] and none.columns == ["book_id", "ord", "reply", "status"]


def test_requests_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = asked_of(spark, 50).mapInArrow(count, "book_id long, ord long, request string")
    for times in (1, 2):  # with an empty store, and with a full one
        assert labeling.label_resumably(df, lambda: str.upper, str(tmp_path / "s"), KEYS).count() == 50
        assert made.value == 50 * times
