"""Long exact spans shared between records.

Fingerprints: of all GRAM-character windows those are kept that have the least hash in some stretch of SPAN characters,
so two equal stretches keep the same one. They go into a log-structured index: each batch of texts becomes an immutable
run, bucketed and sorted by hash; a new run is merge-joined with the older ones, bucket by bucket and without another
shuffle, and runs of like size are compacted into one before the next batch is joined.

A fingerprint that occurs in two texts is a candidate. Its surroundings (every stretch of SPAN characters around it) are
compared as a whole by a second, independent hash: where they are equal in another text, all of it is shared. Where they
are not, a span ends nearby: for one text of each kind of surroundings the stretches are hashed one by one and verified
by two independent hashes. Pairs of texts are never formed; copies of one text count as one with a multiplicity.

Hot hashes. What many texts of a task share is settled there and then: the task sends two witnesses on, for the texts
elsewhere, and the others' characters are known to be shared. A hash that many texts of a task hold in differing
surroundings is sent a few times under itself; the task's other rows of it are spread over SALTS slots and compared by
their stretches. So a header of a third of all texts costs its bucket a few rows a task, not one a text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import list_names, materialize, partitions_for, read_text, scratch, write_text_atomic

SPAN = 200
GRAM = 100
SIDE = SPAN - GRAM
SLICE_CHARS = 1 << 20
PIECE_CHARS = 1 << 25
POS_BITS = 26
SALTS = 256
HOT_ROWS = 16
SEEN_BITS = 18
FILTER_BITS = 20

_U = np.uint64
# fixed values: the finalizer of splitmix64
_MIX_1, _MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _MIX_1
    z = (z ^ (z >> _U(27))) * _MIX_2
    return z ^ (z >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse."""

    def __init__(self, base: int, salt: int):
        self.base, self.inverse, self.salt = _U(base), _U(pow(base, -1, 1 << 64)), _U(salt)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if self.up.size <= n:
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.inverse)]))


_ONE, _TWO = _Powers(0x9E3779B97F4A7C15, 0x1F83D9AB), _Powers(0xD1342543DE82EF95, 0x5BE0CD19)


class Rolling:
    """Hashes of any stretch of one sequence of code points in constant time."""

    def __init__(self, points: np.ndarray, powers: _Powers):
        powers.need(points.size + 1)
        self.powers = powers
        c = _mix(points.astype(np.uint64) + powers.salt)
        c *= powers.up[: points.size]
        self.sums = np.zeros(points.size + 1, np.uint64)
        np.cumsum(c, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.powers.down[start])

    def all(self, length: int) -> np.ndarray:
        n = self.sums.size - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.powers.down[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every `width` neighbours: minima from block starts and block ends meet in each window."""
    n = keys.size
    pad = -n % width
    k = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(k, axis=1).ravel()
    after = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash, hash of the surroundings) of the kept windows of texts of SPAN characters or more."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    start = end - size
    one, two = Rolling(points, _ONE), Rolling(points, _TWO)
    h = one.all(GRAM)
    low = _U((1 << POS_BITS) - 1)
    place = np.arange(h.size, dtype=np.uint64)
    least = _least((h & ~low) | (low - (place & low)), SIDE + 1)  # of equal hashes the last one
    owner = np.repeat(np.arange(len(texts)), size)
    first = np.arange(least.size)
    whole = first + SPAN <= end[owner[: least.size]]
    at = (first & ~int(low)) + (low - (least & low)).astype(np.int64)
    at += np.where(at < first, int(low) + 1, 0)
    at = np.unique(at[whole])
    doc = owner[at]
    left, right = np.maximum(at - SIDE, start[doc]), np.minimum(at + SPAN, end[doc])
    around = _mix(two.of(left, right) + (at - left).astype(np.uint64) * _U(0x10001) + (right - at).astype(np.uint64))
    return doc, at - start[doc], h[at].view(np.int64), around.view(np.int64)


def _batches(numbers: list, texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[list, list]]:
    held_n, held_t, size = [], [], 0
    for n, t in zip(numbers, texts):
        held_n.append(n), held_t.append(t)
        size += len(t)
        if size >= limit:
            yield held_n, held_t
            held_n, held_t, size = [], [], 0
    if held_n:
        yield held_n, held_t


def _settle(same: np.ndarray, kin: np.ndarray) -> np.ndarray:
    """Which rows, with an equality key and a text each, are known to be shared and need not be sent on.

    Of rows of one key in two texts or more, those of the least and the greatest text are witnesses and are sent; the
    others are known to be shared. Rows alone in their key are sent.
    """
    _, group = np.unique(same, axis=0, return_inverse=True)
    group = group.ravel()
    m = int(group.max()) + 1 if group.size else 0
    lo, hi = np.full(m, np.iinfo(np.int64).max), np.full(m, np.iinfo(np.int64).min)
    np.minimum.at(lo, group, kin)
    np.maximum.at(hi, group, kin)
    return (kin != lo[group]) & (kin != hi[group])


class _Seen:
    """For the keys met so far by a task, the least and greatest text and how often: a table of one row a slot.

    It only saves rows: a key that lost its slot to another is met as if for the first time.
    """

    def __init__(self):
        n = 1 << SEEN_BITS
        self.key, self.n = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (_mix(key.view(np.uint64)) >> _U(64 - SEEN_BITS)).astype(np.int64)

    def often(self, key: np.ndarray, least: int) -> np.ndarray:
        """Which keys were met `least` times or more before, in two texts or more."""
        at = self._slot(key)
        return (self.key[at] == key) & (self.n[at] >= least) & (self.lo[at] != self.hi[at])

    def add(self, key: np.ndarray, kin: np.ndarray) -> None:
        if not key.size:
            return
        order = np.lexsort((kin, key))
        k, t = key[order], kin[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.concatenate([first[1:], [k.size]]) - 1
        k, lo, hi, n = k[first], t[first], t[last], last - first + 1
        at = self._slot(k)
        same = (self.key[at] == k) & (self.n[at] > 0)
        take = ~same & (self.n[at] <= n)
        for mine, old in ((same, True), (take, False)):
            i = at[mine]
            self.key[i] = k[mine]
            self.lo[i] = np.minimum(self.lo[i], lo[mine]) if old else lo[mine]
            self.hi[i] = np.maximum(self.hi[i], hi[mine]) if old else hi[mine]
            self.n[i] = self.n[i] + n[mine] if old else n[mine]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two."""
    return _mix(_mix(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)


PRINT = "h bigint, around bigint, kin bigint, doc bigint, pos int, n int, state int"
PLAIN, KNOWN, HOT, MARK = 0, 1, 2, 3


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the texts of a task; a text met again in it is not printed again.

    state KNOWN: the surroundings are shared; the row stands under its text, not under the hash. state HOT: the task
    has sent the hash in two texts and HOT_ROWS rows already. MARK: a copy of the task's first hot row of a hash, kept
    under the hash, so that those there know of the others.
    """
    seen: set[int] = set()
    marked: set[int] = set()
    whole, single = _Seen(), _Seen()
    names = ["h", "around", "kin", "doc", "pos", "n", "state"]
    for b in batches:
        todo: list[tuple[int, int, int, int, str]] = []
        for doc, kin, text in zip(*(c.to_pylist() for c in b.columns)):
            if kin in seen:
                continue
            if len(seen) > 2_000_000:
                seen.clear()
            seen.add(kin)
            # very long texts go in pieces that overlap by one stretch less one character
            for lo in range(0, max(1, len(text) - SPAN + 1), PIECE_CHARS):
                todo.append((doc, kin, lo, len(text), text[lo : lo + PIECE_CHARS + SPAN - 1]))
        for held, texts in _batches(todo, [x[4] for x in todo]):
            of, pos, h, around = fingerprints(texts)
            doc, kin, lo, n = (np.array([x[i] for x in held], np.int64)[of] for i in range(4))
            both = _pair(h, around)
            known = _settle(both[:, None], kin) | whole.often(both, 1)
            whole.add(both[~known], kin[~known])
            hot = ~known & single.often(h, HOT_ROWS)
            plain = ~known & ~hot
            single.add(h[plain], kin[plain])
            state = np.where(known, KNOWN, np.where(hot, HOT, PLAIN)).astype(np.int32)
            cells = (np.where(known, kin, h), np.where(known, pos + lo, around), kin, doc)
            small = ((pos + lo).astype(np.int32), n.astype(np.int32), state)
            columns = [*cells, *small]
            at = [i for i in np.unique(h[hot], return_index=True)[1].tolist()] if hot.any() else []
            at = [i for i in np.flatnonzero(hot)[at].tolist() if int(h[i]) not in marked]
            if at:
                if len(marked) > 1_000_000:
                    marked.clear()
                marked.update(h[at].tolist())
                again = [c[at] for c in columns[:-1]] + [np.full(len(at), MARK, np.int32)]
                columns = [np.concatenate([c, x]) for c, x in zip(columns, again)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _kin():
    """Equal for equal texts."""
    return F.xxhash64("text", F.lit(7))


def _salted(h, salt):
    """The slot of a hot hash."""
    return F.xxhash64(h, salt)


def print_texts(docs: DataFrame) -> DataFrame:
    """Fingerprints of `docs` (doc_id, text); see PRINT. kin is a hash of the whole text, n its length.

    slot, by which rows are kept together, is the hash, or for hot rows one of SALTS chosen by the surroundings.
    """
    long = docs.filter(F.length("text") >= SPAN)
    rows = long.select("doc_id", _kin().alias("kin"), "text").mapInArrow(_print, PRINT)
    salt = F.pmod("around", F.lit(SALTS)).cast("int")
    return rows.select(F.when(F.col("state") == HOT, _salted(F.col("h"), salt)).otherwise(F.col("h")).alias("slot"), "*")


ROW = "slot bigint, " + PRINT


class SpanIndex:
    """Immutable runs of fingerprints, bucketed and sorted by slot, in the shared folder.

    The runs are files of one bucketed table, one sorted file of a bucket for each run, so scans of one run or of all
    come partitioned by slot and join or group without a shuffle. A run counts once the manifest names it; runs have
    names of their own, so what a failed append left behind is never read. Compaction writes a new table and publishes
    it in the same way. Open the same path again to go on with later batches.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self.manifest().get("buckets", buckets)  # fixed once made
        self.tables: set[str] = set()

    def manifest(self) -> dict:
        names = [x for x in list_names(self.spark, self.path) if x.startswith("manifest-") and x.endswith(".json")]
        if not names:
            return {"version": 0, "table": f"prints_{uuid.uuid4().hex}", "runs": []}
        return json.loads(read_text(self.spark, f"{self.path}/{names[-1]}"))

    def _publish(self, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1, "buckets": self.buckets}
        write_text_atomic(self.spark, f"{self.path}/manifest-{manifest['version']:012d}.json", json.dumps(manifest))

    def _write(self, rows: DataFrame, table: str, run: int) -> int:
        """Rows, already one task for each bucket, as sorted files; how many."""
        self.tables.add(table)
        (
            rows.withColumn("run", F.lit(run).cast("long")).write.mode("append").bucketBy(self.buckets, "slot").sortBy("slot")
            .option("path", f"{self.path}/{table}").saveAsTable(f"weftline_{table}")
        )
        return self.rows(table, [run]).count()

    def rows(self, table: str, runs: list[int]) -> DataFrame:
        """The rows of runs, partitioned by slot."""
        self.tables.add(table)
        if not self.spark.catalog.tableExists(f"weftline_{table}"):
            self.spark.sql(
                f"CREATE TABLE weftline_{table} ({ROW}, run bigint) USING parquet CLUSTERED BY (slot) SORTED BY (slot) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'"
            )
        return self.spark.table(f"weftline_{table}").filter(F.col("run").isin(runs))

    def append(self, docs: DataFrame) -> DataFrame:
        """Add a batch as a run; give what it shares with the older runs and in itself: (kin, doc, pos, n, single, asked).

        The rows are those of the batch and of older runs that stand in a slot of the batch. single: no other text has
        the same surroundings. asked: the stretches around the place are to be compared one by one.
        """
        self.compact()
        manifest = self.manifest()
        table, run = manifest["table"], uuid.uuid4().int >> 66
        size = self._write(print_texts(docs).repartition(self.buckets, "slot"), table, run)
        old = [r["run"] for r in manifest["runs"]]
        self._publish(manifest | {"runs": [*manifest["runs"], {"run": run, "rows": size}]})
        new = self.rows(table, [run])
        if not old:
            return _status(new.filter(F.col("state") != KNOWN)).unionByName(_known(new))
        slots = new.filter(F.col("state") != KNOWN).select("slot").distinct()
        older = self.rows(table, old).filter(F.col("state") != KNOWN)
        met = self.rows(table, [*old, run]).join(slots.hint("merge"), "slot", "left_semi")
        # hot rows of older runs stand in other slots than their hash: those of a hash that the batch holds
        hot = older.filter(F.col("state") == HOT).select("h").distinct()
        fresh = new.filter(F.col("state") == PLAIN).select("h").distinct()
        salts = hot.join(fresh, "h", "left_semi").select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salts = salts.select(_salted(F.col("h"), F.col("salt")).alias("slot"))
        spread = self.rows(table, [*old, run]).filter(F.col("state") == HOT).join(salts, "slot", "left_semi")
        return _status(met.filter(F.col("state") != KNOWN)).unionByName(_known(new)).unionByName(_status(spread))

    def compact(self) -> None:
        """Merge the newest runs of like size into one, without repeated rows, in a new table.

        A run is merged with the one before it while that is at most twice as large, so each row is rewritten a number
        of times logarithmic in the number of batches. Known rows have done their work and are dropped.
        """
        manifest = self.manifest()
        runs = manifest["runs"]
        if len(runs) < 2 or runs[-2]["rows"] > 2 * runs[-1]["rows"]:
            return
        keep = len(runs) - 2
        total = runs[-1]["rows"] + runs[-2]["rows"]
        while keep and runs[keep - 1]["rows"] <= 2 * total:
            keep -= 1
            total += runs[keep]["rows"]
        table, run = f"prints_{uuid.uuid4().hex}", uuid.uuid4().int >> 66
        kept = self.rows(manifest["table"], [r["run"] for r in runs[keep:]]).filter(F.col("state") != KNOWN)
        size = self._write(_distinct(kept), table, run)
        for r in runs[:keep]:
            self._write(_distinct(self.rows(manifest["table"], [r["run"]])), table, r["run"])
        self._publish(manifest | {"table": table, "runs": [*runs[:keep], {"run": run, "rows": size}]})

    def close(self) -> None:
        """Forget the tables' names; their files stay."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS weftline_{t}")
        self.tables.clear()


def _distinct(rows: DataFrame) -> DataFrame:
    """One row for each (text, position), in the same task."""
    return rows.groupBy("slot", "h", "around", "kin", "pos", "n", "state").agg(F.min("doc").alias("doc")).select("slot", "h", "around", "kin", "doc", "pos", "n", "state")


def _known(rows: DataFrame) -> DataFrame:
    """The rows that their task knew to be shared."""
    no = F.lit(False)
    return rows.filter(F.col("state") == KNOWN).select("kin", "doc", "pos", "n", no.alias("single"), no.alias("asked"))


def _status(rows: DataFrame) -> DataFrame:
    """Which rows are shared as a whole and which are to be compared by stretches; the others are left out."""
    slot, around, hot = Window.partitionBy("slot"), Window.partitionBy("slot", "around"), F.col("state") >= HOT
    return (
        rows.withColumn("mixed", hot | (F.min("kin").over(slot) != F.max("kin").over(slot)))
        .filter("mixed")
        .withColumn("single", F.min("kin").over(around) == F.max("kin").over(around))
        .withColumn("rank", F.row_number().over(around.orderBy("kin", "pos")))
        .withColumn("ends", F.max(F.col("single") | hot).over(slot))
        .select("kin", "doc", "pos", "n", "single", (F.col("ends") & (F.col("single") | (F.col("rank") == 1))).alias("asked"))
    )


STRETCH = "wh bigint, chk bigint, kin bigint, start bigint, known boolean"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each stretch of SPAN characters round the asked positions of a text."""
    names = ["wh", "chk", "kin", "start", "known"]
    settled = _Seen()
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns)))
        for held, texts in _batches(rows, [r[2] for r in rows]):
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            end = np.cumsum(size)
            one, two = Rolling(points, _ONE), Rolling(points, _TWO)
            found: list[tuple] = []
            for many in (0, 1):
                asked = [np.array(r[3 + many] or (), np.int64) for r in held]
                of = np.repeat(np.arange(len(held)), [a.size for a in asked])
                pos = np.concatenate(asked) if asked else np.zeros(0, np.int64)
                starts = (pos[:, None] + np.arange(-SIDE, 1)).ravel()
                of = np.repeat(of, SIDE + 1)
                ok = (starts >= 0) & (starts + SPAN <= size[of])
                at = np.unique(starts[ok] + (end - size)[of[ok]])
                if not at.size:
                    continue
                of = np.searchsorted(end, at, "right")
                kin = np.full(at.size, MANY, np.int64) if many else np.array([r[1] for r in held], np.int64)[of]
                wh, chk = one.of(at, at + SPAN).view(np.int64), two.of(at, at + SPAN).view(np.int64)
                found.append((wh, chk, kin, at - (end - size)[of]))
            if found:
                wh, chk, kin, start = (np.concatenate(c) for c in zip(*found))
                both = _pair(wh, chk)
                known = _settle(both[:, None], kin) | settled.often(both, 1)
                settled.add(both[~known], kin[~known])
                cols = (np.where(known, kin, wh), np.where(known, start, chk), kin, start, known)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


MANY = np.iinfo(np.int64).min


def _merge_intervals(rows: DataFrame, key: str) -> DataFrame:
    """(key, span_start, span_chars): the union of intervals [a, b) of each key; touching ones are one."""
    w = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        island.groupBy(key, "island").agg(F.min("a").alias("span_start"), F.max("b").alias("_end"))
        .select(key, "span_start", (F.col("_end") - F.col("span_start")).alias("span_chars"))
    )


def shared_spans(spark: SparkSession, docs: DataFrame, batches: int = 3, index: SpanIndex | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, span_start, span_chars): the maximal runs of shared characters of each document, in code points.

    A character is shared if it lies in a stretch of SPAN characters that another doc_id's text also holds.

    With an `index` that holds earlier batches, `docs` are the new documents and `corpus` all of them with the earlier
    ones: the result is what the new documents share with any, for new and earlier documents; the work is that of the
    new documents and of what they meet.

    Defined results. Null texts and texts of fewer than SPAN characters share nothing. Documents with equal texts share
    all of them. Rows that repeat a doc_id with the same text are one document; rows with a null doc_id are left out.
    Very long texts are cut into overlapping pieces for fingerprints only. Other columns are not read. An empty table
    gives no rows.
    """
    base = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    every = base if corpus is None else corpus.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    buckets = partitions_for(spark, base, expand=2.0)
    own = index is None
    index = index or SpanIndex(spark, scratch(spark, "spans"), buckets)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(batches))
    parts = [materialize(spark, index.append(base.filter(turn == i)), "met") for i in range(batches)]
    if own:
        index.close()
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    whole = met.filter(~F.col("single")).select(
        "kin", F.greatest(F.col("pos") - SIDE, F.lit(0)).cast("long").alias("a"), F.least(F.col("pos") + SPAN, F.col("n")).cast("long").alias("b")
    ).distinct()
    # near a span's end: each text of its own surroundings, and one for all texts of common surroundings
    asked = (
        met.filter("asked").groupBy("kin")
        .agg(
            F.min("doc").alias("doc"),
            F.collect_set(F.when(F.col("single"), F.col("pos"))).alias("own"),
            F.collect_set(F.when(~F.col("single"), F.col("pos"))).alias("many"),
        )
    )
    # a filter before the texts move: at most 2^FILTER_BITS rows of one number, whatever the input
    place = F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(1 << FILTER_BITS)).cast("int").alias("place")
    places = met.filter("asked").select(place).distinct()
    texts = every.select(F.col("doc_id").alias("doc"), _kin().alias("_k"), "text").withColumn("place", place)
    texts = texts.join(F.broadcast(places), "place", "left_semi").join(asked, "doc")
    texts = texts.filter(F.col("_k") == F.col("kin")).select("doc", "kin", "text", "own", "many")
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = texts.mapInArrow(_stretches, STRETCH).repartition(max(parts_n, buckets), "wh")
    by_stretch = Window.partitionBy("wh", "chk")
    ends = (
        hashed.withColumn("lo", F.min("kin").over(by_stretch)).withColumn("hi", F.max("kin").over(by_stretch))
        .filter(((F.col("lo") != F.col("hi")) | F.col("known")) & (F.col("kin") != MANY))
        .select("kin", F.col("start").alias("a"), (F.col("start") + SPAN).alias("b"))
    )
    runs = _merge_intervals(whole.unionByName(ends), "kin")

    # back to documents: those with copies are shared from end to end, the others have their text's runs
    ids = every.filter(F.length("text") >= SPAN).select("doc_id", _kin().alias("kin"), F.length("text").cast("long").alias("n")).distinct()
    copies = ids.groupBy("kin").agg(F.count("*").alias("copies"))
    known = ids.join(copies.filter(F.col("copies") > 1).select("kin", F.lit(True).alias("copied")), "kin", "left")
    same = known.filter("copied").select("doc_id", F.lit(0).cast("long").alias("span_start"), F.col("n").alias("span_chars"))
    rest = known.filter("copied is null").join(runs, "kin").select("doc_id", "span_start", "span_chars")
    return same.unionByName(rest)


def shared_parts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document with a text."""
    size = docs.filter(F.col("text").isNotNull()).select("doc_id", F.length("text").cast("long").alias("n_chars"))
    total = spans.groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"))
    got = F.coalesce("shared_chars", F.lit(0))
    return size.join(total, "doc_id", "left").select(
        "doc_id", "n_chars", got.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, got / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"),
    )
