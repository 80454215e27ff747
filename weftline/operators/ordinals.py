"""Persistent ordinals of keys, and membership of snapshots as stored compressed bitmaps.

A key keeps its ordinal for good, so bitmaps made at different times can be compared. Keys are split into shards by
hash; ordinals are dense within a shard. A bitmap row holds at most 65,536 keys of one shard, group and snapshot, so no
row and no task grows with a group.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.bitmap import Bitmap
from weftline.session import list_names, read_text, write_text_atomic

CHUNK_BITS = 16
KEYS = "shard int, grp string, key string, ordinal bigint"
CHUNKS = "shard int, slice int, grp string, snapshot_no int, chunk bigint, bits binary"


class KeyOrdinals:
    """(shard, grp, key) -> ordinal in immutable segments; a manifest, published by one rename, names them."""

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.shards = self.manifest().get("shards", shards)  # fixed once made

    def manifest(self) -> dict:
        names = [n for n in list_names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.path}/{names[-1]}")) if names else {"version": 0, "segments": []}

    def table(self) -> DataFrame:
        keys = self.manifest().get("keys", [])
        if not keys:
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(*[f"{self.path}/{s}/part=key" for s in keys])

    def publish(self, segment: str) -> None:
        """Make a written segment part of the store. Its keys stand under part=key."""
        manifest = self.manifest()
        version = manifest["version"] + 1
        keys = manifest.get("keys", []) + [segment] * ("part=key" in list_names(self.spark, f"{self.path}/{segment}"))
        body = json.dumps({"version": version, "segments": [*manifest["segments"], segment], "keys": keys, "shards": self.shards})
        write_text_atomic(self.spark, f"{self.path}/manifest-{version:012d}.json", body)

    def shard(self):
        return F.pmod(F.xxhash64("grp", "key"), F.lit(self.shards)).cast("int")

    def extend(self, keys: DataFrame) -> DataFrame:
        """Give the keys (grp, key) that have no ordinal the next ones of their shard; returns the whole table.

        Keys with a null part have no identity and get none. Known keys are never renumbered.
        """
        known = self.table()
        fresh = keys.select("grp", "key").filter(F.col("grp").isNotNull() & F.col("key").isNotNull()).distinct()
        fresh = fresh.join(known.select("grp", "key"), ["grp", "key"], "left_anti").withColumn("shard", self.shard())
        top = known.groupBy("shard").agg((F.max("ordinal") + 1).alias("base"))
        n = F.row_number().over(Window.partitionBy("shard").orderBy("grp", "key")) - 1
        rows = fresh.withColumn("n", n).join(top, "shard", "left")
        segment = f"segment-{uuid.uuid4().hex}"
        out = rows.select("shard", "grp", "key", (F.coalesce("base", F.lit(0)) + F.col("n")).alias("ordinal"), F.lit("key").alias("part"))
        out.write.partitionBy("part").parquet(f"{self.path}/{segment}")
        self.publish(segment)
        return self.table()


def membership(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The keys of each snapshot as compressed chunks; see CHUNKS. slice, which parts a shard's keys, is 0.

    `rows` has grp, snapshot_no, key; repeated rows are one. Each group of the aggregation holds at most 2^16 ordinals.
    """
    placed = (
        rows.select("grp", "snapshot_no", "key").join(ordinals, ["grp", "key"])
        .select("shard", "grp", "snapshot_no", F.shiftright("ordinal", CHUNK_BITS).alias("chunk"), F.col("ordinal").bitwiseAND((1 << CHUNK_BITS) - 1).alias("low"))
        .distinct()
    )

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        bits = Bitmap.of(t["low"].to_numpy()).to_bytes()
        shard, grp, no, chunk = (k.as_py() for k in key)
        types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array([c], ty) for c, ty in zip((shard, 0, grp, no, chunk, bits), types)], names=["shard", "slice", "grp", "snapshot_no", "chunk", "bits"])

    return placed.groupBy("shard", "grp", "snapshot_no", "chunk").applyInArrow(pack, CHUNKS)


def membership_changes(chunks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(grp, snapshot_no, added, removed, common) of each snapshot against the preceding one, from bitmaps alone.

    `snapshots` has grp, snapshot_no, prev_no of all existing snapshots. A snapshot without rows counts as empty; one
    without a predecessor gives no row.
    """
    pairs = snapshots.filter(F.col("prev_no").isNotNull()).select("grp", "snapshot_no", "prev_no")
    place = ["grp", "snapshot_no", "shard", "slice", "chunk"]
    now = pairs.join(chunks, ["grp", "snapshot_no"]).select(*place, F.col("bits").alias("now"))
    old = pairs.join(chunks.withColumnRenamed("snapshot_no", "prev_no"), ["grp", "prev_no"]).select(*place, F.col("bits").alias("old"))
    both = now.join(old, place, "full_outer").select("grp", "snapshot_no", "now", "old")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for x, y in zip(b["now"].to_pylist(), b["old"].to_pylist()):
                new, was = Bitmap.from_bytes(x), Bitmap.from_bytes(y)
                counts.append((len(new.and_not(was)), len(was.and_not(new)), len(new.and_(was))))
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b["grp"], b["snapshot_no"], *(pa.array(n[:, i]) for i in range(3))], names=["grp", "snapshot_no", "added", "removed", "common"])

    counted = both.mapInArrow(compare, "grp string, snapshot_no int, added bigint, removed bigint, common bigint")
    total = counted.groupBy("grp", "snapshot_no").agg(*[F.sum(c).alias(c) for c in ("added", "removed", "common")])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "removed", "common")]
    return pairs.join(total, ["grp", "snapshot_no"], "left").select("grp", "snapshot_no", *zero)
