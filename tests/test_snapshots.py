from datetime import datetime

from weftline.operators import snapshot_diff
from weftline.operators.ordinals import KeyOrdinals
from weftline.operators.snapshot_diff import snapshot_changes
from weftline.session import scratch

ROWS = "repo string, snapshot_no int, delivery_no int, node_id string, a string, tags array<string>, meta string, created_at timestamp, grp string, change_kind string"
DELIVERIES = "repo string, snapshot_no int, delivery_no int, status string, delivered_at timestamp, key string"


def at(n):
    return datetime(2025, 1, 1, 0, 0, n)


def run(spark, rows, deliveries, store=None):
    got = snapshot_changes(
        spark, spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS), spark.createDataFrame([(*d, at(0), "k") for d in deliveries], DELIVERIES),
        group="repo", key="node_id", fields=["a", "tags", "meta"], json_fields=["meta"], store=store,
    )
    return {tuple(r) for r in got.collect()}


def test_changes(spark):
    rows = [
        ("r", 1, 1, "n1", "x", None, '{"p": 1, "q": "é"}', at(1)),
        ("r", 1, 1, "n1", "old", None, None, at(0)),  # an older row of the node
        ("r", 1, 1, "n2", "x", [], None, at(1)),
        ("r", 1, 1, "n2", "x", [], None, at(1)),  # delivered twice
        ("r", 1, 1, "n3", None, ["b", "a"], None, None),
        ("r", 1, 2, "aborted", "x", None, None, at(1)),
        ("r", 3, 1, "wrong delivery", "x", None, None, at(1)),
        ("r", 3, 2, "n1", "x", None, '{"q":"\\u00e9","p":1.0}', at(1)),  # the same value
        ("r", 3, 2, "n2", "x", None, None, at(1)),  # an empty array and null differ
        ("r", 3, 2, "n3", "y", ["a", "b"], '{"p":null}', at(1)),
        ("r", 3, 2, "n4", "x" * 100_000, None, "", at(1)),
        ("s", 1, 1, "n1", "x", None, None, at(1)),
        (None, 1, 1, "n1", "x", None, None, at(1)),
        ("r", 3, 2, None, "x", None, None, at(1)),
    ]
    deliveries = [("r", 1, 1, "complete"), ("r", 1, 2, "aborted"), ("r", 2, 1, "aborted"), ("r", 3, 1, "complete"), ("r", 3, 2, "complete"), ("r", 4, 1, "complete"), ("s", 1, 1, "complete")]
    got = run(spark, rows, deliveries)
    assert {(g[1], g[2], g[3], g[4]) for g in got} == {
        (3, "n2", "changed", "tags"), (3, "n3", "changed", "a"), (3, "n3", "changed", "tags"), (3, "n3", "changed", "meta"), (3, "n4", "added", ""),
        (4, "n1", "removed", ""), (4, "n2", "removed", ""), (4, "n3", "removed", ""), (4, "n4", "removed", ""),
    }
    assert ("r", 3, "n3", "changed", "tags", '["b","a"]', '["a","b"]') in got
    assert {g[0] for g in got} == {"r"}


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("r", 1, 1, "complete"), ("r", 2, 1, "complete")]) == set()


def test_one_node_holds_most_rows(spark):
    rows = [("r", 1, 1, "hot", str(i), None, None, at(i % 50)) for i in range(30_000)] + [("r", 2, 1, "hot", "z", None, None, at(1))]
    got = run(spark, rows, [("r", 1, 1, "complete"), ("r", 2, 1, "complete")])
    assert {(g[2], g[3], g[4], g[6]) for g in got} == {("hot", "changed", "a", "z")}


def test_a_second_run_renumbers_nothing(spark):
    first = [("r", n, 1, f"n{i}", str(i), None, None, at(1)) for n in (1, 2) for i in range(n, 300)]
    more = [("r", 3, 1, f"n{i}", str(i % 7), None, None, at(1)) for i in range(100, 500)]
    deliveries = [("r", n, 1, "complete") for n in (1, 2, 3)]
    path = scratch(spark, "store")
    old = run(spark, first, deliveries[:2], path)
    table = lambda: {(r.grp, r.key): (r.shard, r.ordinal) for r in KeyOrdinals(spark, path, 99).table().collect()}
    before = table()
    new = run(spark, first + more, deliveries, path)
    after = table()
    assert len(before) == 299 and len(after) == 499 and all(after[k] == v for k, v in before.items())
    assert len(set(after.values())) == len(after)
    assert old < new and new == run(spark, first + more, deliveries)
    kept = table()
    assert run(spark, first + more, deliveries, path) == new and table() == kept


def test_slices_of_a_shard(monkeypatch):
    """Small batches and slices give what one large slice gives; the shard is worked through key by key."""
    import numpy as np
    import pyarrow as pa

    n = 400
    key = np.repeat(np.arange(n // 2), 2)
    t = pa.table({
        "shard": pa.array([0] * n, pa.int32()), "grp": ["g"] * n, "key": [f"k{i:05d}" for i in key], "snapshot_no": pa.array([1, 2] * (n // 2), pa.int32()),
        "prev_no": pa.array([None, 1] * (n // 2), pa.int32()), "next_no": pa.array([2, None] * (n // 2), pa.int32()), "_stamp": pa.array([0] * n, pa.int64()),
        "_row": pa.array(range(n), pa.int64()), "_known": pa.nulls(n, pa.int64()), "f_a": [str(i % 3) for i in range(n)],
    })
    task = snapshot_diff._differ(["f_a"], set(), False)

    def out(size, rows):
        monkeypatch.setattr(snapshot_diff, "SLICE_ROWS", rows)
        got = [r for b in task(iter(t.to_batches(size))) for r in b.to_pylist()]
        return {(r["part"], r["key"], r["ordinal"], r["change_kind"], r["field_name"]) for r in got if r["part"] != "bits"}

    assert out(1000, 10**6) == out(7, 10) == out(1, 1) == out(50, 60)
