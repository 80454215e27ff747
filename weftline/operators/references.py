"""References to records that do not exist at the time they are made.

Parent keys are range-partitioned by their 64-bit hash. Each range is one row of sorted arrays: the keys, and for each
key its life spans merged into disjoint intervals. Batches of references are probed against a range by binary search,
first for the key, then for the time. Ranges that take many references are cut into slices, so that one hot key spreads
over many tasks; each slice sees the whole range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import partitions_for

SLICE_ROWS = 200_000
MOST_BITS = 30
HOT_RANGES = 1 << 20
FAR = np.int64(1) << 62
OUT = "ref_table string, ref_no bigint, ref_field string, ref_value string, reason string, observed_us bigint"


def _range_of(h, bits: int):
    """The range number of a hash: its high bits, so ranges are in hash order."""
    return F.shiftright(h, 64 - bits).cast("int") if bits else F.lit(0)


def parent_index(parents: DataFrame, bits: int) -> DataFrame:
    """(range_no, parents): per range the parents' life spans (h, key, born, gone), sorted. Times in microseconds.

    Overlapping spans of a key are merged first: rows of one birth in each task before they move, then by a window that
    streams over the key's births; so a key that was recorded very often is a few spans, not a long array. A key with an
    unknown birth keeps one span with a null birth.
    """
    w = Window.partitionBy("key").orderBy("born")
    born, far = F.col("born"), F.lit(int(FAR))
    end = F.when(born.isNotNull(), F.greatest(F.coalesce("gone", far), born))
    spans = parents.filter(F.col("key").isNotNull()).select("key", "born", end.alias("gone")).groupBy("key", "born").agg(F.max("gone").alias("gone"))
    reach = F.max("gone").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("_new", F.when(born <= reach, 0).when(born.isNull(), 0).otherwise(1))
    island = opens.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("key", "_i").agg(F.min("born").alias("born"), F.max("gone").alias("gone"))
    h = F.xxhash64("key")
    rows = merged.select(_range_of(h, bits).alias("range_no"), F.struct(h.alias("h"), "key", "born", "gone").alias("p"))
    return rows.groupBy("range_no").agg(F.sort_array(F.collect_list("p")).alias("parents"))


class _Range:
    """Sorted arrays of one range of parents, ready for binary search."""

    def __init__(self, parents: pa.StructArray):
        h, key = parents.field("h").to_numpy(zero_copy_only=False), parents.field("key")
        born_null = np.asarray(parents.field("born").is_null())
        born = parents.field("born").fill_null(0).to_numpy(zero_copy_only=False)
        gone = parents.field("gone").fill_null(int(FAR)).to_numpy(zero_copy_only=False)
        n = h.size
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | np.asarray(pc.not_equal(key.slice(1), key.slice(0, max(0, n - 1))))
        number = np.cumsum(new) - 1
        self.hashes, self.keys = h[new], key.filter(pa.array(new))
        m = self.hashes.size
        # `late` needs every row of the key to be recorded later
        self.first_born = np.full(m, FAR)
        np.minimum.at(self.first_born, number[~born_null], born[~born_null])
        self.unknown_born = np.zeros(m, bool)
        self.unknown_born[number[born_null]] = True
        # life spans of a key, merged: the interval that began last before a time decides
        live = ~born_null & (gone > born)
        i, b, g = number[live], born[live], gone[live]
        order = np.lexsort((b, i))
        i, b, g = i[order], b[order], g[order]
        reach = np.zeros(i.size, np.int64)
        at = 0
        for cut in [*(np.flatnonzero(np.diff(i)) + 1).tolist(), i.size]:
            if cut > at:
                reach[at:cut] = np.maximum.accumulate(g[at:cut])
            at = cut
        self.times = np.unique(b)
        self.code = i * (self.times.size + 1) + np.searchsorted(self.times, b) + 1
        self.of, self.reach = i, reach

    def verdict(self, h: np.ndarray, key: pa.Array, when: np.ndarray, known: np.ndarray) -> np.ndarray:
        """0 found, 1 missing, 2 late, 3 deleted."""
        m = self.hashes.size
        out = np.full(h.size, 1, np.int8)
        if not m:
            return out
        at = np.searchsorted(self.hashes, h, "left")
        hit = np.zeros(h.size, bool)
        probe, idx = at.copy(), np.arange(h.size)
        while idx.size:  # more than one step only where different keys share a hash
            idx = idx[(probe[idx] < m)]
            idx = idx[self.hashes[probe[idx]] == h[idx]]
            same = np.asarray(pc.equal(self.keys.take(pa.array(probe[idx])), key.take(pa.array(idx))))
            hit[idx[same]] = True
            at[idx[same]] = probe[idx[same]]
            idx = idx[~same]
            probe[idx] += 1
        k = np.where(hit, at, 0)
        out[hit] = 3
        late = hit & known & ~self.unknown_born[k] & (self.first_born[k] > when)
        out[late] = 2
        if self.code.size:
            code = k * (self.times.size + 1) + np.searchsorted(self.times, when, "right")
            slot = np.searchsorted(self.code, code, "right") - 1
            ok = slot >= 0
            s = np.where(ok, slot, 0)
            out[hit & known & ok & (self.of[s] == k) & (self.reach[s] > when)] = 0
        return out


_REASON = np.array(["", "missing", "late", "deleted"], object)


def _probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    del key
    empty = pa.schema([("ref_table", pa.string()), ("ref_no", pa.int64()), ("ref_field", pa.string()),
                       ("ref_value", pa.string()), ("reason", pa.string()), ("observed_us", pa.int64())])
    if not left.num_rows:
        return empty.empty_table()
    flat = right["parents"].combine_chunks().flatten() if right.num_rows else None
    if flat is None or not len(flat):
        verdict = np.ones(left.num_rows, np.int8)
    else:
        when = left["observed_us"].combine_chunks()
        verdict = _Range(flat).verdict(
            left["h"].to_numpy(), left["ref_value"].combine_chunks(),
            when.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(when.is_valid()),
        )
    miss = np.flatnonzero(verdict)
    got = left.select(["ref_table", "ref_no", "ref_field", "ref_value", "observed_us"]).take(pa.array(miss))
    reason = pa.array(_REASON[verdict[miss]], pa.string())
    got = got.add_column(4, "reason", reason).cast(empty)
    return got.group_by(empty.names, use_threads=False).aggregate([]).select(empty.names)


def orphan_references(spark: SparkSession, refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose parent is not alive when they are made.

    `refs` has ref_table, ref_no, ref_field, ref_value, observed_at; `parents` has key, born, gone (timestamps).
    Returns (ref_table, ref_no, ref_field, ref_value, reason, period), one row per distinct value.
    reason: `missing` if no parent has the key, `late` if all parents of the key are born after the time, else
    `deleted`. A parent is alive from born (inclusive) to gone (exclusive); a null gone means still alive.

    Defined results. A null reference is no reference. Where observed_at is null no parent can be shown to be alive:
    the reason is `missing` or `deleted` and the period null. A parent with a null born is never alive, yet it is
    there, so the reason is not `missing`, nor `late`. Empty and very long keys are keys like any other. Repeated rows
    give one row. Empty parents make every reference missing.
    """
    bits = max(4, min(MOST_BITS, (partitions_for(spark, parents, target=4 << 20, expand=6.0) - 1).bit_length()))
    index = parent_index(
        parents.select(
            F.col("key"), F.unix_micros(F.col("born").cast("timestamp")).alias("born"),
            F.unix_micros(F.col("gone").cast("timestamp")).alias("gone"),
        ),
        bits,
    )
    h = F.xxhash64("ref_value")
    probes = refs.filter(F.col("ref_value").isNotNull()).select(
        _range_of(h, bits).alias("range_no"), h.alias("h"), "ref_table", "ref_no", "ref_field", "ref_value",
        F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_us"),
    )
    # ranges with many references are cut into slices. A hot range holds more than one part in HOT_RANGES of all
    # references, so at most HOT_RANGES rows of two ints are broadcast, whatever the input
    load = probes.groupBy("range_no").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(SLICE_ROWS), load.agg(F.ceil(F.sum("n") / HOT_RANGES)).scalar())
    hot = load.filter(F.col("n") > most).select("range_no", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    one = F.coalesce("slices", F.lit(1))
    cut = probes.join(F.broadcast(hot), "range_no", "left").withColumn("slice", F.pmod(F.xxhash64("ref_table", "ref_no"), one).cast("int"))
    copies = index.join(F.broadcast(hot), "range_no", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), one - 1)))
    out = (
        cut.select("range_no", "slice", "h", "ref_table", "ref_no", "ref_field", "ref_value", "observed_us")
        .groupBy("range_no", "slice")
        .cogroup(copies.select("range_no", "slice", "parents").groupBy("range_no", "slice"))
        .applyInArrow(_probe, OUT)
    )
    stamp = F.timestamp_micros("observed_us")
    return out.select(
        "ref_table", "ref_no", "ref_field", "ref_value", "reason", F.date_format(stamp, "yyyy-MM").alias("period")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Misses by table, field, month and reason."""
    return orphans.groupBy("ref_table", "ref_field", "period", "reason").agg(
        F.count("*").alias("n_refs"), F.countDistinct("ref_value").alias("n_values")
    )
