import numpy as np

from weftline.functions.bitmap import Bitmap
from weftline.operators import ordinals as O
from weftline.session import scratch


def keys(spark, *k):
    return spark.createDataFrame(list(k), "grp string, key string")


def test_ordinals_are_kept_and_dense(spark):
    store = O.KeyOrdinals(spark, scratch(spark, "ordinals"), 3)
    first = {(r.grp, r.key): (r.shard, r.ordinal) for r in store.extend(keys(spark, *[("g", f"k{i}") for i in range(50)], ("g", "k1"), (None, "x"), ("g", None))).collect()}
    again = O.KeyOrdinals(spark, store.path, 99)  # the shards of the store hold
    second = {(r.grp, r.key): (r.shard, r.ordinal) for r in again.extend(keys(spark, ("g", "k3"), ("h", "k3"), *[("g", f"n{i}") for i in range(30)])).collect()}
    assert len(first) == 50 and len(second) == 81
    assert all(second[k] == v for k, v in first.items())
    for shard in range(3):
        got = sorted(o for s, o in second.values() if s == shard)
        assert got == list(range(len(got)))


def test_bytes_round_trip():
    for values in ([], [0], list(range(70_000)), [5, 70_000, 200_001]):
        assert Bitmap.from_bytes(Bitmap.of(np.array(values, np.int64)).to_bytes()).ordinals().tolist() == values
    assert len(Bitmap.from_bytes(None)) == 0


def test_changes_from_bitmaps(spark):
    store = O.KeyOrdinals(spark, scratch(spark, "ordinals"), 2)
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 1, "b"), ("g", 3, "b"), ("g", 3, "c"), ("g", 3, "d"), ("h", 1, "a")], "grp string, snapshot_no int, key string")
    chunks = O.membership(rows, store.extend(rows))
    snaps = spark.createDataFrame([("g", 1, None), ("g", 3, 1), ("g", 4, 3), ("h", 1, None)], "grp string, snapshot_no int, prev_no int")
    assert sorted(tuple(r) for r in O.membership_changes(chunks, snaps).collect()) == [("g", 3, 2, 1, 1), ("g", 4, 0, 3, 0)]
    assert O.membership_changes(chunks.limit(0), snaps.limit(0)).count() == 0
