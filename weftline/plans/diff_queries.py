"""Differences, change classes, partial rebuilds, rules and merges, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import diff as D
from weftline.operators import rules as R
from weftline.session import table

ORDER_FIELDS = ["o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]


def _before(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", *ORDER_FIELDS)


def _after(spark: SparkSession, d: str) -> DataFrame:
    """A later state: every tenth order gone, every seventh changed, new ones from the shifted keys of every ninth."""
    b = _before(spark, d)
    k = F.col("o_orderkey")
    kept = b.filter(k % 10 != 0)
    changed = kept.withColumn("o_totalprice", F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    changed = changed.withColumn("o_orderstatus", F.when(k % 21 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return changed.unionByName(b.filter(k % 9 == 0).withColumn("o_orderkey", k + 100_000_000))


def diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    got = D.keyed_diff(_before(spark, d), _after(spark, d), "o_orderkey", ORDER_FIELDS)
    return got.select("o_orderkey", "change", F.array_join("changed_fields", ",").alias("changed_fields"))


def diff_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """One row for each field that differs, with its values."""
    got = D.keyed_diff(_before(spark, d), _after(spark, d), "o_orderkey", ORDER_FIELDS).filter(F.col("change") == "changed")
    cell = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"before.{f}").cast("string").alias("b"), F.col(f"after.{f}").cast("string").alias("a")) for f in ORDER_FIELDS])
    one = got.select("o_orderkey", F.explode(cell).alias("c"))
    return one.filter(~F.col("c.b").eqNullSafe(F.col("c.a"))).select("o_orderkey", "c.field", F.col("c.b").alias("before"), F.col("c.a").alias("after"))


def diff_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges order to customer, added and removed."""
    edge = F.concat(F.lit("order:"), F.col("o_orderkey"), F.lit("--placed-by-->customer:"), F.col("o_custkey"))
    b, a = _before(spark, d).select(edge.alias("id")), _after(spark, d).select(edge.alias("id"))
    return D.keyed_diff(b.withColumn("x", F.lit(1)), a.withColumn("x", F.lit(1)), "id", ["x"]).select("id", "change")


def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.summary(D.keyed_diff(_before(spark, d), _after(spark, d), "o_orderkey", ORDER_FIELDS))


def _hashed(spark: SparkSession, d: str, later: bool) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    k = F.col("doc_id")
    if later:
        docs = docs.filter(k % 11 != 0).withColumn("text", F.when(k % 5 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    else:
        docs = docs.filter(k % 13 != 0)
    return docs.select("doc_id", F.sha2("text", 256).alias("h"))


def change_classes(spark: SparkSession, d: str) -> DataFrame:
    return D.change_classes(_hashed(spark, d, False), _hashed(spark, d, True), "doc_id", "h")


def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    got = D.change_classes(_hashed(spark, d, False), _hashed(spark, d, True), "doc_id", "h")
    return got.groupBy("class").agg(F.count("*").alias("n"))


def partial_rebuild_merge(spark: SparkSession, d: str) -> DataFrame:
    """Unchanged rows are reused, changed and added ones taken fresh; the result equals a full rebuild."""
    old, new = _hashed(spark, d, False), _hashed(spark, d, True)
    classes = D.change_classes(old, new, "doc_id", "h")
    fresh = new.join(classes.filter(F.col("class").isin("added", "changed")), "doc_id", "left_semi")
    return D.reuse_merge(old, fresh, "doc_id", classes.filter(F.col("class") == "removed"))


def manifest_flat_diff(spark: SparkSession, d: str) -> DataFrame:
    def record(df: DataFrame) -> DataFrame:
        return df.agg(
            F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.max("o_orderkey").alias("last_key"),
            F.count("o_orderstatus").alias("with_status"), F.min("o_orderpriority").alias("least_priority"),
        )

    return D.flat_diff(record(_before(spark, d)), record(_after(spark, d)))


def bag_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as a bag: renumbered lines cancel, single ones pair by order and part."""
    cols = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]
    items = table(spark, d, "lineitem", *cols, "l_linenumber", "l_suppkey").distinct()
    k = F.col("l_orderkey")
    ident = lambda df: df.withColumn("identity", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).withColumn(
        "pair", F.concat_ws("/", "l_orderkey", "l_partkey")
    )
    later = items.withColumn("l_linenumber", F.when(k % 4 == 0, F.col("l_linenumber") + 50).otherwise(F.col("l_linenumber")))
    later = later.withColumn("l_quantity", F.when(k % 10 == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).filter(k % 50 != 2)
    return D.bag_diff(ident(items), ident(later), ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"], "pair", "identity")


def provenance_merge(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "node_registry", "node_id")
    used = table(spark, d, "lineage_edges", "source").select(F.col("source").alias("node_id")).filter(F.col("node_id").isNotNull())
    return D.provenance(reg, used, "node_id", ("registry", "lineage"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "file_no", "path", "content").distinct()


def classification_rules(spark: SparkSession, d: str) -> DataFrame:
    got = _files(spark, d).select("file_no", F.explode(R.file_rules(F.col("path"), F.coalesce("content", F.lit("")))).alias("r"))
    return got.select("file_no", "r.role", "r.confidence")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_no", R.resolve(R.file_rules(F.col("path"), F.coalesce("content", F.lit("")))).alias("v"))


def classification_conflicts(spark: SparkSession, d: str) -> DataFrame:
    got = _resolved(spark, d).select("file_no", "v.conflict", F.explode("v.classes").alias("c"))
    return got.select("file_no", "c.role", "c.confidence", "conflict")


def classification_guidance(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("file_no", R.guidance(F.col("v.classes")).alias("guidance"))


def confidence_merge_high(spark: SparkSession, d: str) -> DataFrame:
    return R.merged_confidence(table(spark, d, "lineage_edges", "edge_id", "confidence"), ["edge_id"], "confidence", R.LINEAGE_LEVELS, False)


def confidence_merge_low(spark: SparkSession, d: str) -> DataFrame:
    return R.merged_confidence(table(spark, d, "node_registry", "node_id", "confidence"), ["node_id"], "confidence", R.LINEAGE_LEVELS, True)


def lineage_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Observations of one edge merged: the higher confidence, the first kind, the union of evidence files."""
    rows = table(spark, d, "lineage_edges", "edge_no", "edge_id", "kind", "confidence", "evidence_refs").distinct()
    files = F.transform(F.filter(F.coalesce("evidence_refs", F.array()), lambda e: e["file_path"].isNotNull()), lambda e: e["file_path"])
    got = R.upsert(rows.withColumn("files", files), "edge_id", "edge_no", ["kind"], "confidence", R.LINEAGE_LEVELS, "files")
    return got.select("edge_id", "kind", "confidence", F.array_join("files", "|").alias("files"))


def distinct_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.first_of(table(spark, d, "events", "event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def role_application(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the roles observed on them, gathered and sorted; nodes without any keep an empty list."""
    nodes = table(spark, d, "node_registry", "node_id").distinct()
    edges = table(spark, d, "lineage_edges", "source", "kind")
    roles = edges.groupBy(F.col("source").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("roles"))
    return nodes.join(roles, "node_id", "left").select("node_id", F.coalesce("roles", F.lit("")).alias("roles"))


def unique_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_type", "p_brand").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


def config_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of each repository's settings: its languages and roles, sorted, with the extractor's revision."""
    rows = table(spark, d, "source_files", "repo", "language", "role")
    per = rows.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("l"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("r"))
    return per.select("repo", D.fingerprint({"languages": F.col("l"), "roles": F.col("r"), "revision": "1"}).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (
    diff_nodes, diff_changed_fields, diff_edges, diff_summary, change_classes, refresh_summary, partial_rebuild_merge,
    manifest_flat_diff, bag_pairing, provenance_merge, classification_rules, classification_conflicts,
    classification_guidance, confidence_merge_high, confidence_merge_low, lineage_upsert, distinct_first_wins,
    role_application, unique_sorted, config_fingerprint,
)}

_AB = """
WITH b AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders),
a AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM b WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderpriority, o_orderstatus, o_totalprice FROM b WHERE o_orderkey % 9 = 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, b.o_orderkey IS NULL AS add, a.o_orderkey IS NULL AS del,
    CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END AS f1, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END AS f2,
    CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END AS f3, CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END AS f4,
    b.o_orderstatus AS bs, a.o_orderstatus AS sa
  FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey),
n AS (SELECT o_orderkey, CASE WHEN add THEN 'added' WHEN del THEN 'removed' WHEN concat_ws(',', f1, f2, f3, f4) <> '' THEN 'changed' END AS change,
  concat_ws(',', f1, f2, f3, f4) AS fs, bs, sa FROM j)"""
_HASH = """
WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0),
a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || chr(10) ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS class
  FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id)"""
_RULES = r"""
WITH f AS (SELECT DISTINCT file_no, path, content FROM source_files),
p AS (SELECT file_no, path, string_split(path, '/')[-1] AS base, coalesce(content, '') AS says FROM f),
m AS (
  SELECT file_no, 'generated-file' AS role, 'likely' AS confidence FROM p WHERE regexp_matches(path, '(^|/)generated/|\.(generated|gen)\.[jt]sx?$')
  UNION ALL SELECT file_no, 'configuration-file', 'likely' FROM p WHERE regexp_matches(base, '\.config\.[jt]s$|^tsconfig.*\.json$|^package\.json$|^\..*rc$')
  UNION ALL SELECT file_no, 'command-handler', CASE WHEN regexp_matches(says, 'export\s+(async\s+)?function\s+register\w*Command') THEN 'certain' ELSE 'likely' END
    FROM p WHERE regexp_matches(path, '(^|/)commands/.*') AND regexp_matches(base, 'Command\.ts$')
  UNION ALL SELECT file_no, 'validator', CASE WHEN regexp_matches(says, 'export\s+function\s+(is|assert)[A-Z]\w*') THEN 'likely' ELSE 'possible' END
    FROM p WHERE regexp_matches(base, 'valid(ate|ation|ator)', 'i') OR regexp_matches(path, '(^|/)validators/')
  UNION ALL SELECT file_no, 'analyzer', CASE WHEN regexp_matches(base, 'analy[sz]er', 'i') THEN 'likely' ELSE 'possible' END FROM p WHERE regexp_matches(base, 'analy[sz]er|^build|^apply', 'i')
  UNION ALL SELECT file_no, 'test-fixture', 'certain' FROM p WHERE regexp_matches(path, '(^|/)tests/') OR regexp_matches(base, '\.spec\.')
  UNION ALL SELECT file_no, 'internal-planning-docs', 'certain' FROM p WHERE regexp_matches(path, '(^|/)planning/')
  UNION ALL SELECT file_no, 'public-docs', 'likely' FROM p WHERE regexp_matches(path, '(^|/)docs/.*\.md$') OR regexp_matches(base, '^readme', 'i')),
r AS (SELECT *, CASE confidence WHEN 'certain' THEN 3 WHEN 'likely' THEN 2 ELSE 1 END AS rank FROM m),
best AS (SELECT *, max(rank) OVER (PARTITION BY file_no) AS top FROM r),
kept AS (SELECT file_no, role, confidence, count(*) OVER (PARTITION BY file_no) AS n FROM best WHERE rank = top),
res AS (SELECT file_no, role, CASE WHEN n > 1 THEN 'possible' ELSE confidence END AS confidence, n > 1 AS conflict FROM kept)"""
_LEVEL = "CASE {c} WHEN 'explicit' THEN 4 WHEN 'inferred-static' THEN 3 WHEN 'partial' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
_NAME = "CASE {r} WHEN 4 THEN 'explicit' WHEN 3 THEN 'inferred-static' WHEN 2 THEN 'partial' WHEN 1 THEN 'unknown' END"
_C = _LEVEL.format(c="confidence")
_RECORD = """SELECT CAST(count(*) AS VARCHAR) AS orders, CAST(count(DISTINCT o_custkey) AS VARCHAR) AS customers, CAST(max(o_orderkey) AS VARCHAR) AS last_key,
  CAST(count(o_orderstatus) AS VARCHAR) AS with_status, min(o_orderpriority) AS least_priority FROM"""
_BAG_ID = "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS identity, concat_ws('/', l_orderkey, l_partkey) AS pair"

SQL = {
    "diff_nodes": _AB + " SELECT o_orderkey, change, CASE WHEN change = 'changed' THEN fs END AS changed_fields FROM n WHERE change IS NOT NULL",
    "diff_changed_fields": _AB + """
, c AS (SELECT b.o_orderkey, unnest([
  {'field': 'o_custkey', 'before': CAST(b.o_custkey AS VARCHAR), 'after': CAST(a.o_custkey AS VARCHAR)},
  {'field': 'o_orderpriority', 'before': b.o_orderpriority, 'after': a.o_orderpriority},
  {'field': 'o_orderstatus', 'before': b.o_orderstatus, 'after': a.o_orderstatus},
  {'field': 'o_totalprice', 'before': CAST(b.o_totalprice AS VARCHAR), 'after': CAST(a.o_totalprice AS VARCHAR)}], recursive := true)
  FROM b JOIN a ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, field, before, after FROM c WHERE before IS DISTINCT FROM after""",
    "diff_edges": _AB + """
, eb AS (SELECT 'order:' || o_orderkey || '--placed-by-->customer:' || o_custkey AS id FROM b), ea AS (SELECT 'order:' || o_orderkey || '--placed-by-->customer:' || o_custkey AS id FROM a)
SELECT id, 'added' AS change FROM ea WHERE id NOT IN (SELECT id FROM eb) UNION ALL SELECT id, 'removed' FROM eb WHERE id NOT IN (SELECT id FROM ea)""",
    "diff_summary": _AB + " SELECT change, count(*) AS n FROM n WHERE change IS NOT NULL GROUP BY change",
    "change_classes": _HASH + " SELECT doc_id, class FROM c",
    "refresh_summary": _HASH + " SELECT class, count(*) AS n FROM c GROUP BY class",
    "partial_rebuild_merge": _HASH + " SELECT doc_id, h FROM a",
    "manifest_flat_diff": _AB + f"""
, rb AS ({_RECORD} b), ra AS ({_RECORD} a),
ub AS (SELECT unnest(['orders', 'customers', 'last_key', 'with_status', 'least_priority']) AS field, unnest([orders, customers, last_key, with_status, least_priority]) AS before FROM rb),
ua AS (SELECT unnest(['orders', 'customers', 'last_key', 'with_status', 'least_priority']) AS field, unnest([orders, customers, last_key, with_status, least_priority]) AS after FROM ra)
SELECT field, before, after FROM ub FULL OUTER JOIN ua USING (field) WHERE before IS DISTINCT FROM after""",
    "bag_pairing": f"""
WITH i AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
l AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber + 50 ELSE l_linenumber END AS l_linenumber,
  CASE WHEN l_orderkey % 10 = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM i WHERE l_orderkey % 50 <> 2),
s AS (SELECT 'b' AS side, l_orderkey, l_partkey, l_quantity, l_returnflag, {_BAG_ID} FROM i UNION ALL SELECT 'a', l_orderkey, l_partkey, l_quantity, l_returnflag, {_BAG_ID} FROM l),
x AS (SELECT * FROM s WHERE identity NOT IN (SELECT identity FROM s GROUP BY identity HAVING count_if(side = 'a') > 0 AND count_if(side = 'b') > 0)),
y AS (SELECT *, count_if(side = 'a') OVER g AS na, count_if(side = 'b') OVER g AS nb FROM x WINDOW g AS (PARTITION BY l_orderkey, l_partkey, l_quantity, l_returnflag)),
z AS (SELECT *, count_if(side = 'a') OVER p AS pa, count_if(side = 'b') OVER p AS pb FROM y WHERE na <> nb WINDOW p AS (PARTITION BY pair))
SELECT identity, CASE WHEN pa = 1 AND pb = 1 THEN 'changed' WHEN side = 'a' THEN 'added' ELSE 'removed' END AS change FROM z""",
    "provenance_merge": """
WITH r AS (SELECT DISTINCT node_id FROM node_registry), l AS (SELECT DISTINCT source AS node_id FROM lineage_edges WHERE source IS NOT NULL)
SELECT coalesce(r.node_id, l.node_id) AS node_id, CASE WHEN r.node_id IS NULL THEN 'lineage' WHEN l.node_id IS NULL THEN 'registry' ELSE 'both' END AS origin
FROM r FULL OUTER JOIN l ON r.node_id = l.node_id""",
    "classification_rules": _RULES + " SELECT file_no, role, confidence FROM m",
    "classification_conflicts": _RULES + " SELECT file_no, role, confidence, conflict FROM res",
    "classification_guidance": _RULES + """
, g AS (SELECT f.file_no, coalesce(string_agg(role, ',') , '') AS roles, bool_or(confidence = 'possible') AS possible FROM f LEFT JOIN res USING (file_no) GROUP BY f.file_no)
SELECT file_no, CASE WHEN contains(roles, 'generated-file') THEN 'generated-do-not-edit' WHEN contains(roles, 'configuration-file') THEN 'inspect-before-edit'
  WHEN contains(roles, 'internal-planning-docs') THEN 'read-only-reference' WHEN contains(roles, 'public-docs') THEN 'docs-only' WHEN contains(roles, 'test-fixture') THEN 'test-only'
  WHEN roles = '' THEN 'uncertain' WHEN possible THEN 'inspect-before-edit' WHEN regexp_matches(roles, 'command-handler|analyzer|validator') THEN 'safe-primary-edit-target'
  ELSE 'inspect-before-edit' END AS guidance FROM g""",
    "confidence_merge_high": f"SELECT edge_id, {_NAME.format(r='r')} AS confidence FROM (SELECT edge_id, max({_C}) AS r FROM lineage_edges GROUP BY edge_id)",
    "confidence_merge_low": f"SELECT node_id, {_NAME.format(r='r')} AS confidence FROM (SELECT node_id, min({_C}) AS r FROM node_registry GROUP BY node_id)",
    "lineage_upsert": f"""
WITH e AS (SELECT DISTINCT edge_no, edge_id, kind, confidence, list_transform(coalesce(evidence_refs, []), lambda x: x.file_path) AS fs FROM lineage_edges),
s AS (SELECT edge_id, max({_C}) AS r, arg_min(kind, edge_no) FILTER (kind IS NOT NULL) AS kind FROM e GROUP BY edge_id),
u AS (SELECT edge_id, string_agg(DISTINCT p, '|' ORDER BY p) AS files FROM (SELECT edge_id, unnest(fs) AS p FROM e) WHERE p IS NOT NULL GROUP BY edge_id)
SELECT s.edge_id, s.kind, {_NAME.format(r='s.r')} AS confidence, coalesce(u.files, '') AS files FROM s LEFT JOIN u USING (edge_id)""",
    "distinct_first_wins": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "role_application": """
WITH k AS (SELECT source, string_agg(DISTINCT kind, ',' ORDER BY kind) AS roles FROM lineage_edges GROUP BY source)
SELECT n.node_id, coalesce(k.roles, '') AS roles FROM (SELECT DISTINCT node_id FROM node_registry) n LEFT JOIN k ON k.source = n.node_id""",
    "unique_sorted": "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type",
    "config_fingerprint": """
SELECT repo, sha256('languages=' || coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') || chr(10) || 'revision=1' || chr(10) || 'roles=' || coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '')) AS fingerprint
FROM source_files GROUP BY repo""",
}
