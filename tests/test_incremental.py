from datetime import datetime, timedelta

import pytest

from weftline.operators.incremental import ContentState, replay_runs
from weftline.session import list_names, scratch

RECORDS = "repo string, path string, content_sha256 string, arrived_at timestamp, arrival_no bigint, run string, step int"
RUNS = "run_no int, repo string, started_at timestamp, status string"
T = datetime(2025, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def state_of(spark):
    return ContentState(spark, scratch(spark, "state"), ["path"])


def batch(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, content_hash string")


def test_only_new_and_changed(spark):
    s = state_of(spark)
    assert rows(s.process(batch(spark, ("a", "1"), ("b", None)), "r1")) == [("a", "1", 1), ("b", None, 1)]
    assert rows(s.process(batch(spark, ("a", "1"), ("b", "2")), "r2")) == [("b", "2", 2)]
    assert rows(s.process(batch(spark), "r3")) == []
    assert rows(s.state()) == [("a", "1"), ("b", "2")]


def test_a_failed_run_is_done_again_and_a_done_run_is_not(spark, monkeypatch):
    s = state_of(spark)
    s.process(batch(spark, ("a", "1")), "r1")

    def broken(manifest):
        raise OSError("lost before the commit")

    monkeypatch.setattr(s, "_publish", broken)
    with pytest.raises(OSError):
        s.process(batch(spark, ("a", "2")), "r2")
    monkeypatch.undo()
    assert s.manifest()["version"] == 1  # nothing of the failed run is visible
    assert rows(s.process(batch(spark, ("a", "2")), "r2")) == [("a", "2", 2)]
    assert rows(s.process(batch(spark, ("a", "9")), "r2")) == [("a", "2", 2)]  # already committed
    assert rows(s.state()) == [("a", "2")]


def test_two_writers_cannot_publish_one_version(spark):
    s = state_of(spark)
    s._publish({"version": 1, "segments": [], "runs": {}})
    with pytest.raises(FileExistsError):
        s._publish({"version": 1, "segments": [], "runs": {}})


def test_compaction_keeps_the_state(spark):
    s = state_of(spark)
    s.process(batch(spark, ("a", "1"), ("b", "1")), "r1")
    s.process(batch(spark, ("a", "2")), "r2")
    s.compact()
    assert len(s.manifest()["segments"]) == 1
    assert rows(s.state()) == [("a", "2"), ("b", "1")]
    assert rows(s.process(batch(spark, ("a", "2"), ("c", "1")), "r3")) == [("c", "1", 4)]
    assert len(list_names(spark, s.path)) >= 5
    assert rows(s.process(batch(spark, ("z", "9")), "r1")) == [("a", "1", 1), ("b", "1", 1)]  # still told after the compaction


def test_a_run_moves_no_state(spark):
    s = state_of(spark)
    s.process(batch(spark, ("a", "1")), "r1")
    m = s.manifest()
    plan = s._known(m)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange" not in plan and "HashAggregate" in plan


def test_replay(spark):
    day = lambda n: T + timedelta(days=n)
    records = [
        ("r", "a", "H1", day(0), 1), ("r", "./a", "h2", day(0), 2),  # the same path and time, the later arrival counts
        ("r", "d\\b", None, day(0), 3), ("r", "d/b", "x", day(2), 4), ("r", "a", "h2", day(2), 5), ("r", "c", "y", day(3), 6),
        ("r", "late", "z", day(9), 7), ("r", None, "z", day(0), 8), (None, "a", "z", day(0), 9), ("q", "a", "h2", day(0), 10), ("r", "a", "H1", day(0), 1),
    ]
    runs = [(1, "r", day(1), "succeeded"), (2, "r", day(2), "failed"), (3, "r", day(4), "succeeded"), (4, "q", day(1), "aborted"), (5, "r", day(5), "succeeded")]
    got = replay_runs(spark, spark.createDataFrame([(*r, "n", 1) for r in records], RECORDS), spark.createDataFrame(runs, RUNS), scratch(spark, "replay"))
    assert rows(got) == [(1, "a", "h2"), (3, "c", "y"), (3, "d/b", "x")]


def test_replay_of_nothing(spark):
    empty = replay_runs(spark, spark.createDataFrame([], RECORDS), spark.createDataFrame([], RUNS), scratch(spark, "replay"))
    assert empty.columns == ["run_no", "path", "content_sha256"] and rows(empty) == []
