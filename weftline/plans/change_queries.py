"""The pN_ queries of the general problems: snapshot changes, orphan references, incremental runs, nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import incremental, nested, ordinals, references, snapshot_diff
from weftline.plans.change_sql import SQL  # noqa: F401
from weftline.session import scratch, ship, table

NODE_FIELDS = [
    "kind", "label", "path", "symbol_name", "symbol_kind", "language", "line", "exported", "classification_roles",
    "route_metadata",
]


NODES = {"group": "repo", "key": "node_id", "fields": NODE_FIELDS, "json_fields": ["route_metadata"]}


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    rows = table(spark, d, "node_snapshots", "repo", "snapshot_no", "delivery_no", "node_id", *NODE_FIELDS, "created_at")
    return rows, table(spark, d, "snapshot_deliveries", "repo", "snapshot_no", "delivery_no", "status")


def _changes(spark: SparkSession, d: str, with_values: bool, store: str | None = None) -> DataFrame:
    return snapshot_diff.snapshot_changes(spark, *_snapshots(spark, d), **NODES, with_values=with_values, store=store)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d, False).select("repo", "snapshot_no", "node_id", "change_kind", "field_name")


def p1_changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """ChangedNodeEntry rows: id, field, before and after."""
    return _changes(spark, d, True).filter(F.col("change_kind") == "changed").drop("change_kind")


def p1_membership(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each snapshot adds, removes and keeps, from the bitmaps that p1_found's pass stores."""
    store = scratch(spark, "snapshots")
    _changes(spark, d, False, store)
    deliveries = table(spark, d, "snapshot_deliveries", "repo", "snapshot_no", "delivery_no", "status")
    known = snapshot_diff.existing_snapshots(deliveries.withColumnRenamed("repo", "grp"))
    return ordinals.membership_changes(snapshot_diff.stored_chunks(spark, store), known).withColumnRenamed("grp", "repo")


def _references(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    edges = table(spark, d, "lineage_edges", "edge_no", "source", "target", "observed_at")
    ends = F.array(
        F.struct(F.lit("source").alias("f"), F.col("source").alias("v")),
        F.struct(F.lit("target").alias("f"), F.col("target").alias("v")),
    )
    from_edges = edges.select("edge_no", "observed_at", F.explode(ends).alias("e")).select(
        F.lit("lineage_edges").alias("ref_table"), F.col("edge_no").alias("ref_no"), F.col("e.f").alias("ref_field"),
        F.col("e.v").alias("ref_value"), "observed_at",
    )
    api = table(spark, d, "api_unresolved", "unresolved_no", "candidate_node_ids", "observed_at")
    from_api = api.select("unresolved_no", "observed_at", F.explode("candidate_node_ids").alias("v")).select(
        F.lit("api_unresolved").alias("ref_table"), F.col("unresolved_no").alias("ref_no"),
        F.lit("candidate_node_ids").alias("ref_field"), F.col("v").alias("ref_value"), "observed_at",
    )
    parents = table(spark, d, "node_registry").select(
        F.col("node_id").alias("key"), F.col("recorded_at").alias("born"), F.col("deleted_at").alias("gone")
    )
    return references.orphan_references(spark, from_edges.unionByName(from_api), parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_references(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    records = table(spark, d, "audit_files", "repo", "path", "content_sha256", "arrived_at", "arrival_no")
    runs = table(spark, d, "index_runs", "run_no", "repo", "started_at", "status")
    return incremental.replay_runs(spark, records, runs, scratch(spark, "runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    reports = table(spark, d, "audit_reports", "report_no", "received_at", "payload")
    rows = nested.shred_reports(reports, ("declarations",)).filter(F.col("value").isNotNull())
    cols = ("record_kind", "root_no", "file_pos", "item_pos", "value")
    envelopes = nested.subjects(table(spark, d, "evidence_envelopes", "envelope_no", "evidence_id", "subject", "received_at"))
    commits = envelopes.select(
        F.lit("envelope").alias("record_kind"), F.col("envelope_no").alias("root_no"), F.lit(-1).alias("file_pos"),
        F.lit(-1).alias("item_pos"), F.col("commit").alias("value"),
    )
    return rows.select(*cols).unionByName(commits)


def _shredded(spark: SparkSession, d: str, kind: str) -> DataFrame:
    ship(spark)
    reports = table(spark, d, "audit_reports", "report_no", "received_at", "payload")
    return nested.shred_reports(reports).filter(F.col("record_kind") == kind).withColumnRenamed("root_no", "report_no")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return _shredded(spark, d, "file").select("report_no", "file_pos", "path", "language", "role", "status", "content_sha256")


def p4_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return _shredded(spark, d, "capability").select(
        "report_no", "file_pos", F.col("name").alias("capability"), F.col("value").alias("status")
    )


def p4_facts(spark: SparkSession, d: str) -> DataFrame:
    return _shredded(spark, d, "fact").select(
        "report_no", "file_pos", F.col("item_pos").alias("fact_pos"), F.col("name").alias("kind"), F.col("value").alias("start_line")
    )


def p4_subjects(spark: SparkSession, d: str) -> DataFrame:
    return nested.subjects(table(spark, d, "evidence_envelopes", "envelope_no", "evidence_id", "subject", "received_at"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_changed_nodes, p1_membership, p2_found, p2_report, p3_found, p4_found, p4_files, p4_capabilities, p4_facts, p4_subjects,
)}
