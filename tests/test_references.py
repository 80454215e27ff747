import random
from datetime import datetime, timedelta

from weftline.operators import references

BASE = datetime(2025, 1, 1)
REFS = "ref_table string, ref_no bigint, ref_field string, ref_value string, observed_at timestamp, h string, key string"
PARENTS = "key string, born timestamp, gone timestamp, ref_value string"


def brute(refs, parents):
    out = set()
    for t, no, f, v, when in refs:
        if v is None:
            continue
        own = [p for p in parents if p[0] == v]
        if when is not None and any(p[1] is not None and p[1] <= when and (p[2] is None or p[2] > when) for p in own):
            continue
        if not own:
            reason = "missing"
        elif when is not None and all(p[1] is not None and p[1] > when for p in own):
            reason = "late"
        else:
            reason = "deleted"
        out.add((t, no, f, v, reason, when.strftime("%Y-%m") if when else None))
    return out


def run(spark, refs, parents):
    got = references.orphan_references(
        spark, spark.createDataFrame([(*r, "x", "y") for r in refs], REFS), spark.createDataFrame([(*p, "z") for p in parents], PARENTS)
    )
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(references, "SLICE_ROWS", 50)  # hot ranges are cut
    rnd = random.Random(5)
    day = lambda: BASE + timedelta(days=rnd.randrange(100))
    parents = []
    for _ in range(150):
        born = day()
        parents.append((f"k{rnd.randrange(60)}", rnd.choice([born, born, None]), rnd.choice([None, born + timedelta(days=rnd.randrange(0, 30))])))
    parents += parents[:20] + [("", BASE, None), (None, BASE, None), ("x" * 50_000, BASE, None)]
    refs = [("t", i, "f", rnd.choice([f"k{rnd.randrange(80)}", "k1", None, "", "x" * 50_000]), rnd.choice([day(), day(), None])) for i in range(1500)]
    refs += refs[:100]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("a", BASE, None)]) == set()
    assert run(spark, [("t", 1, "f", "a", BASE)], []) == {("t", 1, "f", "a", "missing", "2025-01")}


def test_report(spark):
    got = spark.createDataFrame([("t", 1, "f", "a", "late", "2025-01"), ("t", 2, "f", "a", "late", "2025-01")], "ref_table string, ref_no bigint, ref_field string, ref_value string, reason string, period string")
    assert [tuple(r) for r in references.orphan_report(got).collect()] == [("t", "f", "2025-01", "late", 2, 1)]
