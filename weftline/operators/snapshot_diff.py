"""What changed between consecutive full snapshots of a keyed table.

Keys get persistent ordinals, kept in a store (operators/ordinals.py) from one run to the next; each snapshot is a
compressed bitmap of ordinals. AND-NOT of neighbouring bitmaps gives the added and the removed keys, AND gives the common
ones, and vectors of each field aligned on the ordinals show which fields of common keys differ.

Work is split by key hash into the store's shards, so a snapshot of one very large group spreads over all tasks. One
shuffle moves the rows; before it every input batch is cut to one row for each key and snapshot, so a key with very many
rows stays small. A task reads its shard sorted by key, merges the known ordinals in as it goes, and works on slices of
whole keys, so its memory does not follow the size of the shard. What a pass finds (new ordinals, bitmaps, changes) is
written once and published with the store's next manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.bitmap import Bitmap
from weftline.functions.jsonvalue import canonical
from weftline.operators.ordinals import CHUNKS, KeyOrdinals
from weftline.session import partitions_for, scratch

SLICE_ROWS = 150_000
CHANGE = "grp string, snapshot_no int, key string, change_kind string, field_name string, before string, after string"
OUT = "part string, shard int, slice int, ordinal bigint, chunk bigint, bits binary, " + CHANGE


def existing_snapshots(deliveries: DataFrame) -> DataFrame:
    """(grp, snapshot_no, delivery_no, prev_no, next_no) of the snapshots that have a complete delivery."""
    best = (
        deliveries.filter(F.col("status") == "complete")
        .groupBy("grp", "snapshot_no")
        .agg(F.max("delivery_no").alias("delivery_no"))
    )
    w = Window.partitionBy("grp").orderBy("snapshot_no")
    return best.select(
        "grp", "snapshot_no", "delivery_no",
        F.lag("snapshot_no").over(w).alias("prev_no"),
        F.lead("snapshot_no").over(w).alias("next_no"),
    )


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integer codes of a column; equal values have equal codes, null is -1."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    d = a if pa.types.is_dictionary(a.type) else a.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _newest(t: pa.Table) -> np.ndarray:
    """Row numbers of the newest row for each (grp, key, snapshot_no)."""
    if not t.num_rows:
        return np.zeros(0, np.int64)
    stamp = t["_stamp"].combine_chunks()
    order = np.lexsort((
        t["_row"].to_numpy(),
        stamp.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False),
        t["snapshot_no"].to_numpy(),
        _codes(t["key"]),
        _codes(t["grp"]),
    ))
    g, k, s = (_codes(t[c])[order] for c in ("grp", "key", "snapshot_no"))
    last = np.ones(order.size, bool)
    last[:-1] = (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    return order[last]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b])
        keep = _newest(t)
        yield from (t if keep.size == t.num_rows else t.take(pa.array(np.sort(keep)))).to_batches()


class _Vectors:
    """The field values of one partition, aligned on ordinals through row numbers."""

    def __init__(self, t: pa.Table, fields: list[str], json_fields: set[str]):
        self.fields, self.codes, self.values = fields, {}, {}
        for f in fields:
            d = t[f].combine_chunks().dictionary_encode()
            codes = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            self.values[f] = d.dictionary
            if f in json_fields and len(d.dictionary):
                same: dict[str, int] = {}
                remap = np.array([same.setdefault(canonical(x), len(same)) for x in d.dictionary.to_pylist()] + [-1])
                self.codes[f], self.raw = remap[codes], {**getattr(self, "raw", {}), f: codes}
            else:
                self.codes[f], self.raw = codes, {**getattr(self, "raw", {}), f: codes}

    def text(self, f: str, rows: np.ndarray) -> pa.Array:
        codes = self.raw[f][rows]
        picked = self.values[f].take(pa.array(codes, mask=codes < 0))
        return picked.cast(pa.string())


def _arrow(name: str) -> pa.DataType:
    return {"shard": pa.int32(), "slice": pa.int32(), "snapshot_no": pa.int32(), "ordinal": pa.int64(), "chunk": pa.int64(), "bits": pa.binary()}.get(name, pa.string())


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_SCHEMA = pa.schema([(n, _arrow(n)) for n in _NAMES])


def _rows(n: int, **cells) -> pa.RecordBatch:
    """Rows of OUT; a column is an array, one value for all rows, or null."""

    def column(name: str) -> pa.Array:
        v, kind = cells.get(name), _arrow(name)
        if isinstance(v, (pa.Array, pa.ChunkedArray)):
            v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
            return v.cast(kind)
        if isinstance(v, np.ndarray):
            return pa.array(v, kind)
        return pa.nulls(n, kind) if v is None else pa.repeat(pa.scalar(v, kind), n)

    return pa.RecordBatch.from_arrays([column(c) for c in _NAMES], schema=_SCHEMA)


def _text(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _differ(fields: list[str], json_fields: set[str], with_values: bool):
    """A pass over shards sorted by (shard, grp, key): rows of snapshots, known ordinals, and first the next free ordinal."""

    def slice_rows(t: pa.Table, shard: int, number: int, free: int) -> tuple[int, list[pa.RecordBatch]]:
        """One slice of whole keys: its results, and the next free ordinal."""
        out: list[pa.RecordBatch] = []
        is_row = np.asarray(_text(t, "snapshot_no").is_valid())
        rows_t = t.filter(pa.array(is_row))
        rows_t = rows_t.take(pa.array(_newest(rows_t)))
        if not rows_t.num_rows:
            return free, out
        both = pa.concat_tables([t.filter(pa.array(~is_row)).select(["grp", "key", "_known"]), rows_t.select(["grp", "key", "_known"])])
        g, k = _codes(both["grp"]), _codes(both["key"])
        _, number_of = np.unique(np.stack([g, k], axis=1), axis=0, return_inverse=True)
        number_of = number_of.ravel()
        m = both.num_rows - rows_t.num_rows
        ordinal_of = np.full(int(number_of.max()) + 1, -1, np.int64)
        ordinal_of[number_of[:m]] = both["_known"].slice(0, m).combine_chunks().to_numpy(zero_copy_only=False)
        mine = number_of[m:]
        grp, key = _text(rows_t, "grp"), _text(rows_t, "key")
        # keys without an ordinal get the next free ones, in order of their first row
        fresh, first = np.unique(mine[ordinal_of[mine] < 0], return_index=True)
        if fresh.size:
            at = np.flatnonzero(ordinal_of[mine] < 0)[first]
            order = np.argsort(at, kind="stable")
            ordinal_of[fresh[order]] = free + np.arange(fresh.size)
            at = pa.array(at[order])
            out.append(_rows(fresh.size, part="key", shard=shard, grp=grp.take(at), key=key.take(at), ordinal=free + np.arange(fresh.size)))
            free += fresh.size
        ordinal = ordinal_of[mine]
        g = g[m:]
        snap = rows_t["snapshot_no"].to_numpy()
        none_no = -1 << 31
        prev = _text(rows_t, "prev_no").fill_null(none_no).to_numpy(zero_copy_only=False).astype(np.int64)
        nxt = _text(rows_t, "next_no").fill_null(none_no).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = _Vectors(rows_t, fields, json_fields)

        of_snapshot: dict[tuple[int, int], np.ndarray] = {}
        order = np.lexsort((ordinal, snap, g))
        gs, ss = g[order], snap[order]
        cut = np.flatnonzero((gs[1:] != gs[:-1]) | (ss[1:] != ss[:-1])) + 1
        for rows in np.split(order, cut):
            of_snapshot[int(g[rows[0]]), int(snap[rows[0]])] = rows
        maps = {at: Bitmap.of(ordinal[rows]) for at, rows in of_snapshot.items()}
        none = Bitmap()

        def emit(rows, no, kind, field="", before=None, after=None):
            at = pa.array(rows)
            out.append(_rows(rows.size, part="change", grp=grp.take(at), snapshot_no=int(no), key=key.take(at),
                             change_kind=kind, field_name=field, before=before, after=after))

        def rows_of(rows: np.ndarray, wanted: Bitmap) -> np.ndarray:
            return rows[np.searchsorted(ordinal[rows], wanted.ordinals())]

        for (of, no), rows in of_snapshot.items():
            here, before_no, after_no = maps[of, no], int(prev[rows[0]]), int(nxt[rows[0]])
            chunks = here.split()
            name = grp[int(rows[0])].as_py()
            out.append(_rows(len(chunks), part="bits", shard=shard, slice=number, grp=name, snapshot_no=no,
                             chunk=np.array([c for c, _ in chunks], np.int64), bits=pa.array([b for _, b in chunks], pa.binary())))
            if before_no != none_no:
                added = here.and_not(maps.get((of, before_no), none))
                if len(added):
                    emit(rows_of(rows, added), no, "added")
                old = of_snapshot.get((of, before_no))
                if old is not None:
                    common = here.and_(maps[of, before_no])
                    if len(common):
                        b, a = rows_of(old, common), rows_of(rows, common)
                        for f in fields:
                            c = vectors.codes[f]
                            d = np.flatnonzero(c[b] != c[a])
                            if d.size:
                                texts = (vectors.text(f, b[d]), vectors.text(f, a[d])) if with_values else (None, None)
                                emit(a[d], no, "changed", f, *texts)
            if after_no != none_no:
                removed = here.and_not(maps.get((of, after_no), none))
                if len(removed):
                    emit(rows_of(rows, removed), after_no, "removed")
        return free, out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, shard, number, free = 0, -1, 0, 0

        def work(t: pa.Table) -> list[pa.RecordBatch]:
            """Slices of one shard's rows; the shard's first row may be the next free ordinal."""
            nonlocal shard, number, free
            out: list[pa.RecordBatch] = []
            for of in t["shard"].unique().to_pylist():
                part = t.filter(pc.equal(t["shard"], of))
                if of != shard:
                    shard, number, free = of, 0, 0
                base = part.filter(pc.is_null(part["key"]))
                if base.num_rows:
                    free = pc.max(base["_known"]).as_py()
                    part = part.filter(pc.is_valid(part["key"]))
                if part.num_rows:
                    free, got = slice_rows(part, of, number, free)
                    number += 1
                    out += got
            return out

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < SLICE_ROWS:
                continue
            t = pa.Table.from_batches(held)
            # the last key may go on: it stays for the next slice
            tail = t.slice(t.num_rows - 1)
            same = [pc.equal(t[c], tail[c][0]) for c in ("shard", "grp", "key")]
            goes_on = pc.fill_null(pc.and_(pc.and_(same[0], same[1]), same[2]), False)
            cut = t.num_rows - int(pc.sum(goes_on).as_py() or 0)
            rest = t.slice(cut)
            if cut:
                yield from work(t.slice(0, cut))
            elif rest.num_rows:  # one key alone fills the slice
                is_row = pc.is_valid(rest["snapshot_no"])
                rows = rest.filter(is_row)
                rest = pa.concat_tables([rest.filter(pc.invert(is_row)), rows.take(pa.array(np.sort(_newest(rows))))])
            held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from work(pa.Table.from_batches(held))

    return run


def changes_pass(
    spark: SparkSession, rows: DataFrame, deliveries: DataFrame, store: KeyOrdinals, *, group: str, key: str, fields: list[str],
    json_fields: Iterable[str] = (), stamp: str = "created_at", with_values: bool = True,
) -> DataFrame:
    """The rows of one pass, not yet stored; see OUT. part is `key`, `bits` or `change`."""
    known = existing_snapshots(deliveries.select(F.col(group).alias("grp"), "snapshot_no", "delivery_no", "status"))

    def plain(f: str):
        c = F.col(f)
        kind = rows.schema[f].dataType
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c).alias(f"f_{f}")
        return c.cast("string").alias(f"f_{f}")

    cells = [plain(f) for f in fields]
    names = [f"f_{f}" for f in fields]
    base = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("grp"), "snapshot_no", "delivery_no", F.col(key).alias("key"), *cells,
        F.unix_micros(F.col(stamp).cast("timestamp")).alias("_stamp"),
    )
    joined = base.join(known, ["grp", "snapshot_no", "delivery_no"]).drop("delivery_no")
    joined = joined.withColumn("_row", F.xxhash64(*names))
    combined = joined.mapInArrow(_combine, joined.schema)
    placed = combined.withColumn("shard", store.shard()).withColumn("_known", F.lit(None).cast("bigint"))
    held = store.table().select("shard", "grp", "key", F.col("ordinal").alias("_known"))
    free = held.groupBy("shard").agg((F.max("_known") + 1).alias("_known"))
    both = placed.unionByName(held, allowMissingColumns=True).unionByName(free, allowMissingColumns=True)
    # one partition for each shard; nulls come first, so the next free ordinal does
    spread = both.repartitionById(store.shards, "shard").sortWithinPartitions("shard", "grp", "key")
    return spread.mapInArrow(_differ(names, {f"f_{f}" for f in json_fields}, with_values), OUT)


def snapshot_changes(
    spark: SparkSession, rows: DataFrame, deliveries: DataFrame, *, group: str, key: str, fields: list[str],
    json_fields: Iterable[str] = (), stamp: str = "created_at", with_values: bool = True, store: str | None = None,
) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the preceding existing one.

    `rows` has group, snapshot_no, delivery_no, key, the fields and a stamp; `deliveries` has group, snapshot_no,
    delivery_no and status. Returns (group, snapshot_no, key, change_kind, field_name, before, after): one row for an
    added or removed key with field_name '', one row for each differing field of a changed key. `store` is the folder of
    the persistent ordinals; without one, a fresh folder is made. Keys known there keep their ordinals.

    Defined results. Null differs from any value and from an empty array; two nulls are equal. Rows with a null group
    or key have no identity and are left out. A null stamp is older than any other; among rows of equal stamp the one
    of the greatest content hash counts, so repeated rows do no harm. A snapshot with a complete delivery but no rows
    counts as empty. Columns of `rows` that are not named are never read, so clashing names do no harm.
    Empty tables give no rows.
    """
    parts = partitions_for(spark, rows.select(group, key, *fields))
    ordinals = KeyOrdinals(spark, store or scratch(spark, "snapshots"), parts)
    found = changes_pass(spark, rows, deliveries, ordinals, group=group, key=key, fields=fields, json_fields=json_fields, stamp=stamp, with_values=with_values)
    segment = f"pass-{uuid.uuid4().hex}"
    found.write.partitionBy("part").parquet(f"{ordinals.path}/{segment}")
    ordinals.publish(segment)
    change = spark.read.schema("part string, " + CHANGE).parquet(f"{ordinals.path}/{segment}").filter(F.col("part") == "change")
    return change.select(
        F.col("grp").alias(group), "snapshot_no", F.col("key").alias(key), "change_kind",
        F.regexp_replace("field_name", "^f_", "").alias("field_name"), "before", "after",
    )


def stored_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The bitmaps that the last pass over a store wrote; see CHUNKS."""
    ordinals = KeyOrdinals(spark, store, 1)
    last = ordinals.manifest()["segments"][-1]
    return spark.read.schema("part string, " + CHUNKS).parquet(f"{ordinals.path}/{last}").filter(F.col("part") == "bits").drop("part")
