"""Processing only new or changed records, run after run.

The state maps a key to the hash it had at the last committed run. A run hashes (or takes the hash of) the current rows,
joins them with the state, and writes what is new or different as an immutable segment. A numbered manifest names the
segments that make up the state; publishing the next manifest is the only commit. A run that fails before that leaves
nothing visible, so the next run selects the same rows again; a run number that is already in the manifest is not
processed a second time.

The segments are files of one table, bucketed and sorted by two hashes of the key, so a run is merged with the state
bucket by bucket and the state never moves. A segment's rows carry the hash in two numbers with the version above it, so
the newest row of a key is found by a maximum of numbers. Segments are merged into a base when there are many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import list_names, partitions_for, read_text, write_text_atomic

COMPACT_AFTER = 8
HASH_BITS = 40  # of a content hash, twice: 80 bits tell two contents of a key apart; the version has the other 23 bits


class ContentState:
    """Versioned key -> content hash state in a folder shared by all executors."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], types: dict[str, str] | None = None, buckets: int = 8):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        kinds = types or {}
        self.key_fields = [T.StructField(k, T._parse_datatype_string(kinds.get(k, "string"))) for k in self.keys]
        self.order_kind: T.DataType | None = None
        self.buckets = self.manifest().get("buckets", buckets)  # fixed once made

    def order_by(self, kind: T.DataType) -> None:
        """Keep an order with each hash: runs may come in any order, and of a key's records the one greatest in (order, hash) counts."""
        self.order_kind = kind

    @property
    def schema(self) -> T.StructType:
        numbers = [T.StructField(n, T.LongType()) for n in ("version", "k1", "k2", "v1", "v2")]
        order = [T.StructField("order", self.order_kind)] if self.order_kind else []
        return T.StructType([*self.key_fields, T.StructField("content_hash", T.StringType()), *order, *numbers, T.StructField("segment", T.LongType())])

    def manifest(self) -> dict:
        """The newest published manifest."""
        names = [n for n in list_names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if not names:
            return {"version": 0, "table": f"state_{uuid.uuid4().hex}", "segments": [], "runs": {}}
        return json.loads(read_text(self.spark, f"{self.path}/{names[-1]}"))

    def _publish(self, manifest: dict) -> None:
        body = json.dumps(manifest | {"buckets": self.buckets})
        write_text_atomic(self.spark, f"{self.path}/manifest-{manifest['version']:012d}.json", body)

    def key_hashes(self) -> list[Column]:
        """The two numbers by which rows are bucketed."""
        return [F.xxhash64(*self.keys, F.lit(n)).alias(f"k{n}") for n in (1, 2)]

    def _hashes(self) -> list[Column]:
        """The content hash as two numbers of HASH_BITS bits; a null hash is 0."""
        low = F.lit((1 << HASH_BITS) - 1)
        one = lambda n: F.xxhash64("content_hash", F.lit(n)).bitwiseAND(low)
        return [F.when(F.col("content_hash").isNull(), F.lit(0)).otherwise(F.greatest(one(n), F.lit(1))) for n in (1, 2)]

    def _rows(self, table: str, segments: list[int]) -> DataFrame:
        name = f"weftline_{table}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self.spark.catalog.refreshTable(name)  # another session, as those of streams are, may have added files
        return self.spark.table(name).filter(F.col("segment").isin(segments))

    def _write(self, rows: DataFrame, table: str) -> int:
        """A segment of rows that stand in their buckets' tasks; its name."""
        segment = uuid.uuid4().int >> 66
        (
            rows.withColumn("segment", F.lit(segment).cast("long")).write.mode("append").bucketBy(self.buckets, "k1", "k2")
            .sortBy("k1", "k2").option("path", f"{self.path}/{table}").saveAsTable(f"weftline_{table}")
        )
        return segment

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS weftline_{self.manifest()['table']}")

    def state(self, manifest: dict | None = None) -> DataFrame:
        """(keys, content_hash) as of the newest version."""
        return self._newest(manifest or self.manifest()).select(*self.keys, "content_hash")

    def _newest(self, manifest: dict) -> DataFrame:
        """The newest row of each key, whole."""
        kept = ["content_hash", "version", "v1", "v2"] + (["order"] if self.order_kind else [])
        rows = self._rows(manifest["table"], manifest["segments"])
        return rows.groupBy("k1", "k2", *self.keys).agg(F.max_by(F.struct(*kept), "version").alias("_r")).select("k1", "k2", *self.keys, "_r.*")

    def _known(self, manifest: dict) -> DataFrame:
        """(k1, k2, v1, v2) of each key: numbers alone, in the buckets' tasks."""
        rows = self._rows(manifest["table"], manifest["segments"])
        return rows.groupBy("k1", "k2").agg(F.max("v1").alias("v1"), F.max("v2").alias("v2"))

    def runs(self, names: Sequence[str]) -> DataFrame:
        """(run, keys, content_hash, version): what the named runs selected, each table's files read once."""
        where = self.manifest()["runs"]
        wanted = [(where[n][0], where[n][1], n) for n in names if n in where]
        out = None
        for table in dict.fromkeys(t for t, _, _ in wanted):
            named = F.create_map(*[x for t, s, n in wanted if t == table for x in (F.lit(s).cast("long"), F.lit(n))])
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{table}").filter(F.col("segment").isin([s for t, s, _ in wanted if t == table]))
            part = rows.select(named[F.col("segment")].alias("run"), *self.keys, "content_hash", "version")
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], T.StructType([T.StructField("run", T.StringType()), *self.key_fields, T.StructField("content_hash", T.StringType()), T.StructField("version", T.LongType())]))
        return out

    def process(self, current: DataFrame, run: str) -> DataFrame:
        """What run() commits, as rows; see there.

        Returns (keys, content_hash, version) of the changed keys.
        """
        self.run(current, run)
        out = [*self.keys, "content_hash", *(["order"] if self.order_kind else []), "version"]
        return self._of_run(self.manifest()["runs"][run], out)

    def run(self, current: DataFrame, run: str) -> None:
        """Keys of `current` (keys, content_hash; one row per key) whose hash differs from the state, then commit.

        A null hash is kept in the state, so that the key counts as different once it has a hash again. Keys missing from `current` keep their state. With order_by(),
        `current` has a column order too, and the keys are those whose (order, hash) is greater than the state's.
        """
        manifest = self.manifest()
        if run in manifest["runs"]:
            return
        version, low = manifest["version"] + 1, (1 << HASH_BITS) - 1
        kept = [*self.keys, "content_hash"] + (["order"] if self.order_kind else [])
        there = current.select(*kept, *([] if "k1" in current.columns else self.key_hashes()), *[c for c in ("k1", "k2") if c in current.columns])
        h1, h2 = self._hashes()
        base = F.lit(version << HASH_BITS)
        new = there.withColumn("version", F.lit(version).cast("long")).withColumn("v1", base + h1).withColumn("v2", base + h2)
        known = differs = None
        if not manifest["segments"]:
            pass  # everything is new
        elif self.order_kind:
            known = self._newest(manifest).select("k1", "k2", F.col("content_hash").alias("_known"), F.col("order").alias("_order"), F.lit(True).alias("_there"))
            differs = F.col("_there").isNull() | (F.struct("order", "content_hash") > F.struct("_order", "_known"))
        else:
            known = self._known(manifest).select("k1", "k2", F.col("v1").alias("_1"), F.col("v2").alias("_2"))
            other = [F.col(f"v{n}").bitwiseAND(F.lit(low)) != F.col(f"_{n}").bitwiseAND(F.lit(low)) for n in (1, 2)]
            differs = F.col("_1").isNull() | other[0] | other[1]
        met = new.join(known, ["k1", "k2"], "left").filter(differs) if manifest["segments"] else new
        changed = met.select(*[f.name for f in self.schema.fields[:-1]])
        if "k1" not in current.columns:
            changed = changed.repartition(self.buckets, "k1", "k2")
        segment = self._write(changed, manifest["table"])
        self._publish(manifest | {"version": version, "segments": [*manifest["segments"], segment], "runs": manifest["runs"] | {run: [manifest["table"], segment]}})
        if len(manifest["segments"]) + 1 >= COMPACT_AFTER:
            self.compact()

    def _of_run(self, where: list, columns: list[str]) -> DataFrame:
        table, segment = where
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{table}").filter(F.col("segment") == segment).select(*columns)

    def compact(self) -> None:
        """Merge all segments of the state into one in a new table, bucket by bucket; run segments stay for repeated reads."""
        manifest = self.manifest()
        table = f"state_{uuid.uuid4().hex}"
        segment = self._write(self._newest(manifest).select(*[f.name for f in self.schema.fields[:-1]]), table)
        old = manifest["table"]
        self._publish(manifest | {"version": manifest["version"] + 1, "table": table, "segments": [segment]})
        self.spark.sql(f"DROP TABLE IF EXISTS weftline_{old}")


def plain_path(c):
    """`/` for a backslash, and no leading `./`."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def replay_runs(spark: SparkSession, records: DataFrame, runs: DataFrame, state_dir: str) -> DataFrame:
    """Play the succeeded runs of every repository in order through one ContentState; give what each run selects.

    `records` has repo, path, content_sha256, arrived_at, arrival_no; `runs` has run_no, repo, started_at, status.
    The k-th succeeded run of every repository is one step, so there are as many jobs as runs of one repository, not as
    runs in all. Failed and aborted runs commit nothing: their records stay with the next run that succeeds.
    Returns (run_no, path, content_sha256).

    Defined results. Null hashes are kept as state and are no case. Records with a null repo, path or arrival, and those
    after the last succeeded run, belong to no run. Repeated rows and equal arrival times are one current record, the
    greatest arrival_no, then the greatest hash. Empty tables give no rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("repo").orderBy("started_at", "run_no")
    ordered = (
        runs.filter((F.col("status") == "succeeded") & F.col("repo").isNotNull() & F.col("started_at").isNotNull())
        .select("run_no", "repo", "started_at").distinct()
        .withColumn("step", F.row_number().over(w))
    )
    calendar = ordered.groupBy("repo").agg(
        F.sort_array(F.collect_list(F.struct("started_at", "run_no", "step"))).alias("runs")
    )
    # each record belongs to the first succeeded run that starts at or after its arrival
    first = F.get(F.filter("runs", lambda r: r["started_at"] >= F.col("arrived_at")), 0)
    placed = (
        records.filter(F.col("path").isNotNull() & F.col("arrived_at").isNotNull())
        .join(calendar, "repo")
        .select(
            "repo", plain_path(F.col("path")).alias("path"), F.lower("content_sha256").alias("content_hash"),
            "arrived_at", "arrival_no", first.alias("run"),
        )
        .filter(F.col("run").isNotNull())
    )
    newest = F.max(F.struct("arrived_at", "arrival_no", "content_hash")).alias("last")
    state = ContentState(spark, f"{state_dir}/state", ["repo", "path"], buckets=partitions_for(spark, records))
    current = (
        placed.groupBy("repo", "path", F.col("run.step").alias("step"), F.col("run.run_no").alias("run_no"))
        .agg(newest)
        .select("repo", "path", "step", "run_no", F.col("last.content_hash").alias("content_hash"), *state.key_hashes())
    )
    # the rows of each step, bucketed as the state is: a step moves nothing
    prepared = f"{state_dir}/current"
    name = f"weftline_current_{uuid.uuid4().hex}"
    (
        current.repartition(state.buckets, "k1", "k2").write.partitionBy("step").bucketBy(state.buckets, "k1", "k2").sortBy("k1", "k2")
        .option("path", prepared).saveAsTable(name)
    )
    steps = sorted(int(n.split("=", 1)[1]) for n in list_names(spark, prepared) if n.startswith("step="))
    for step in steps:
        state.run(spark.table(name).filter(F.col("step") == step), f"step-{step}")
    got = state.runs([f"step-{step}" for step in steps]).filter(F.col("content_hash").isNotNull())
    out = got.withColumn("step", F.substring_index("run", "-", -1).cast("int"))
    state.close()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out.join(ordered.select("repo", "step", "run_no"), ["repo", "step"]).select(
        "run_no", "path", F.col("content_hash").alias("content_sha256")
    )
