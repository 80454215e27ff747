"""Bundles, capsules, views over the stored graph, regression evaluation, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import bundle as B
from weftline.operators import context as C
from weftline.operators import diff as D
from weftline.operators import graph as G
from weftline.operators import resolve as V
from weftline.operators import rules as R
from weftline.operators import text_search as S
from weftline.plans.search_queries import DOC_QUERY
from weftline.session import materialize, ship, table
from weftline.sources import extract


def numbered_source(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered(table(spark, d, "source_files", "file_no", "content").distinct(), "file_no", "content")


def source_bundles(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    files = table(spark, d, "source_files", "file_no", "path", "content").distinct()
    sym = extract.extract_files(files, ["file_no"]).filter((F.col("record") == "symbol") & (F.col("owner") == ""))
    return B.bundles(materialize(spark, sym.select("file_no", "name", "line", "end_line"), "symbols"), files.select("file_no", "content"), ["file_no"])


def _ranked_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "path")
    found = S.relevance(S.fields(docs, "file", F.col("doc_id").cast("string"), {"path": F.col("path"), "label": F.col("text")}), DOC_QUERY)
    top = found.orderBy(F.desc("score"), F.col("id").cast("long")).limit(B.SLICES)
    return top.select(F.col("id").cast("long").alias("id"), "score", F.row_number().over(Window.orderBy(F.desc("score"), F.col("id").cast("long"))).alias("rank"))


def context_capsule(spark: SparkSession, d: str) -> DataFrame:
    """A task's text to bounded evidence: search, rank, slices with continuations."""
    return B.capsule(_ranked_docs(spark, d), table(spark, d, "documents", "doc_id", "text", "path"), "doc_id", "text", "path")


def search_path_scope(spark: SparkSession, d: str) -> DataFrame:
    """A word of the query that is a path narrows the pool to that path."""
    nodes = table(spark, d, "node_registry", "node_id", "label", "file_path").distinct()
    pool = S.fields(nodes, "node", F.col("node_id"), {"label": F.col("label"), "path": F.col("file_path")}, F.col("file_path"))
    first = nodes.filter(F.col("file_path").isNotNull()).agg(F.min("file_path").alias("p"))
    scoped = pool.join(F.broadcast(first), F.col("path") == F.col("p"), "left_semi")  # one path
    return S.relevance(scoped, "apps").select("id", "score")


def search_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by a role in their nested roles."""
    nodes = table(spark, d, "node_snapshots", "node_id", "classification_roles")
    return nodes.filter(F.exists("classification_roles", lambda r: r == "entry-point")).select("node_id").distinct()


def view_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The lineage as a graph to draw: each edge once, with the labels of its ends and whether both are known."""
    nodes = R.first_of(table(spark, d, "node_registry", "node_id", "label", "recorded_at"), ["node_id"], ["recorded_at", "label"]).select(F.col("node_id").alias("id"), "label")
    edges = table(spark, d, "lineage_edges", "edge_id", "kind", "source", "target").distinct()
    s, t = nodes.toDF("source", "source_label"), nodes.toDF("target", "target_label")
    got = edges.join(s, "source", "left").join(t, "target", "left")
    return got.select("edge_id", "kind", "source_label", "target_label", (F.col("source_label").isNotNull() & F.col("target_label").isNotNull()).alias("complete")).distinct()


def lineage_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """Two steps round the node that most edges point at."""
    edges = table(spark, d, "lineage_edges", "source", "target").filter(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()
    hub = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return G.reach(spark, edges, hub, 2)


def lineage_nodes_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Observations of one node merged: the higher confidence, the first label and file."""
    rows = table(spark, d, "node_registry", "node_id", "label", "file_path", "confidence", "recorded_at").distinct()
    got = R.upsert(rows.withColumn("files", F.filter(F.array("file_path"), lambda x: x.isNotNull())), "node_id", "recorded_at", ["label"], "confidence", R.LINEAGE_LEVELS, "files")
    return got.select("node_id", "label", "confidence", F.array_join("files", "|").alias("files"))


def api_impact(spark: SparkSession, d: str) -> DataFrame:
    """Direct impacts of deleted nodes: unresolved evidence that names one as a candidate; all of it, the first 64 of a node marked."""
    gone = table(spark, d, "node_registry", "node_id", "deleted_at").filter(F.col("deleted_at").isNotNull()).select("node_id").distinct()
    refs = table(spark, d, "api_unresolved", "unresolved_no", "candidate_node_ids").select("unresolved_no", F.explode("candidate_node_ids").alias("node_id")).distinct()
    return D.marked_first(refs.join(gone, "node_id"), "node_id", "unresolved_no", 64, "impacts")


def unresolved_qualification(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by how many of its distinct candidates the registry knows."""
    refs = table(spark, d, "api_unresolved", "unresolved_no", "candidate_node_ids").distinct()
    ids = refs.select("unresolved_no", F.explode_outer("candidate_node_ids").alias("node_id")).distinct()
    known = table(spark, d, "node_registry", "node_id").distinct().withColumn("there", F.lit(True))
    per = ids.join(known, "node_id", "left").groupBy("unresolved_no").agg(F.count("there").alias("n"))
    return per.select("unresolved_no", F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("qualification"), "n")


def semantic_summary_diff(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind and role in the first and the last complete delivery, where they differ."""
    from weftline.operators.snapshot_diff import existing_snapshots

    known = existing_snapshots(table(spark, d, "snapshot_deliveries", "repo", "snapshot_no", "delivery_no", "status").withColumnRenamed("repo", "grp"))
    rows = table(spark, d, "node_snapshots", "repo", "snapshot_no", "delivery_no", "node_id", "kind").withColumnRenamed("repo", "grp").distinct()
    held = rows.join(known, ["grp", "snapshot_no", "delivery_no"]).filter(F.col("prev_no").isNull() | F.col("next_no").isNull())
    first, last = F.col("prev_no").isNull(), F.col("next_no").isNull()
    got = held.groupBy(F.col("grp").alias("repo"), "kind").agg(
        F.count_distinct(F.when(first, F.col("node_id"))).alias("first_nodes"), F.count_distinct(F.when(last, F.col("node_id"))).alias("last_nodes")
    )
    return got.filter(F.col("first_nodes") != F.col("last_nodes"))


def regression_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Expectations about searches, one for each part name, as rates and a verdict for each suite and family.

    A task's results are its parts in order. required: large parts stand among the first 15; forbidden: none of size 1
    is among them; at-most: there are no more than 12 results.
    """
    part = table(spark, d, "part", "p_partkey", "p_name", "p_size").filter(F.col("p_name").isNotNull() & F.col("p_partkey").isNotNull())
    key = F.concat(F.lit("part:"), F.col("p_partkey"))
    suite = F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")
    row = lambda when, family, most: part.filter(when).select(suite.alias("suite"), F.col("p_name").alias("task"), F.lit(family).alias("category"), key.alias("id"), F.lit(most).alias("top_k"))
    limits = part.select(F.lit("all").alias("suite"), F.col("p_name").alias("task"), F.lit("at-most").alias("category"), F.lit(None).cast("string").alias("id"), F.lit(12).alias("top_k")).distinct()
    expect = row(F.col("p_size") > 25, "required", 15).unionByName(row(F.col("p_size") == 1, "forbidden", 15)).unionByName(limits)
    n = F.row_number().over(Window.partitionBy("task").orderBy("id"))
    results = part.select(F.col("p_name").alias("task"), key.alias("id")).withColumn("rank", n)
    got = B.evaluate(expect, results)
    return got.groupBy("suite", "category").agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("expected"), F.round(C.pass_rate(F.col("passed"), F.lit(True)), 6).alias("rate"),
        C.verdict(F.lit(False), ~F.col("passed")).alias("verdict"),
    )


def usage_owner_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes that one edge of a kind joins and another of a kind joins back."""
    uses, owns = F.col("kind").isin("reads-field", "renders-field"), F.col("kind").isin("creates-view-model", "derives-field", "passes-prop")
    e = table(spark, d, "lineage_edges", "kind", "source", "target").filter((uses | owns) & F.col("source").isNotNull() & F.col("target").isNotNull())
    via, end = (F.when(owns, F.col(a)).otherwise(F.col(b)) for a, b in (("target", "source"), ("source", "target")))
    return V.pairs_through(spark, e.select(via.alias("via"), end.alias("end"), owns.alias("owns")))


def overlapping_blocks(spark: SparkSession, d: str) -> DataFrame:
    """How many other evidence lines of the same file lie within five lines of each, without forming pairs."""
    refs = table(spark, d, "lineage_edges", "edge_no", "evidence_refs").distinct().select("edge_no", F.explode("evidence_refs").alias("e"))
    rows = refs.select(F.col("e.file_path").alias("path"), F.col("e.line").alias("line"), "edge_no").filter(F.col("path").isNotNull() & F.col("line").isNotNull()).distinct()
    # counts of a line first: a file has as many rows in the window as it has lines, however many facts
    per = rows.groupBy("path", "line").agg(F.count("*").alias("n"))
    near = per.withColumn("near", F.sum("n").over(Window.partitionBy("path").orderBy("line").rangeBetween(-5, 5)) - 1).drop("n")
    return rows.join(near, ["path", "line"]).select("path", "line", "edge_no", "near")


QUERIES = {f.__name__: f for f in (
    numbered_source, source_bundles, context_capsule, search_path_scope, search_by_role, view_lineage,
    lineage_neighborhood, lineage_nodes_upsert, api_impact, unresolved_qualification, semantic_summary_diff,
    regression_evaluation, usage_owner_pairs, overlapping_blocks,
)}

_C = "CASE confidence WHEN 'explicit' THEN 4 WHEN 'inferred-static' THEN 3 WHEN 'partial' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
_TERMS = X.tokenize(DOC_QUERY)
SQL = {
    "numbered_source": r"""
WITH f AS (SELECT DISTINCT file_no, content FROM source_files WHERE content IS NOT NULL), l0 AS (SELECT file_no, regexp_split_to_array(content, '\r?\n') AS l FROM f),
l AS (SELECT file_no, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM l0), n AS (SELECT file_no, l, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS n FROM l)
SELECT file_no, CAST(n AS INTEGER) AS n, CASE WHEN length(CAST(n AS VARCHAR)) >= 4 THEN left(CAST(n AS VARCHAR), 4) ELSE lpad(CAST(n AS VARCHAR), 4, ' ') END || ' | ' || l[n] AS line FROM n""",
    "context_capsule": f"""
WITH f AS (SELECT doc_id, 'path' AS field, path AS text, 8 AS w FROM documents UNION ALL SELECT doc_id, 'label', text, 6 FROM documents),
t(term, mult, is_term) AS (VALUES ('{DOC_QUERY}', 2, 0), {', '.join(f"('{x}', 1, 1)" for x in _TERMS)}),
r AS (SELECT DISTINCT f.doc_id, f.field, t.term, t.is_term, f.w * t.mult AS weight FROM f JOIN t ON contains(lower(f.text), t.term)),
s AS (SELECT doc_id, CAST(sum(weight) + CASE WHEN count(DISTINCT CASE WHEN is_term = 1 THEN term END) = {len(_TERMS)} THEN 10 ELSE 0 END AS BIGINT) AS score FROM r GROUP BY doc_id),
k AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 8),
l AS (SELECT k.*, path, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS l FROM k JOIN documents USING (doc_id)),
m AS (SELECT rank, doc_id, path, score, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM l)
SELECT rank, doc_id, path, score, CAST(least(len(l), 160) AS INTEGER) AS end_line, len(l) > 160 AS truncated, CASE WHEN len(l) > 160 THEN 161 END AS next_line,
  array_to_string(l[1:160], chr(10)) AS slice FROM m""",
    "search_path_scope": """
WITH n AS (SELECT DISTINCT node_id, label, file_path FROM node_registry WHERE file_path = (SELECT min(file_path) FROM node_registry)),
r AS (SELECT DISTINCT node_id AS id, 'label' AS f, m, 6 * m AS w FROM n, (VALUES (1), (2)) t(m) WHERE contains(lower(label), 'apps')
  UNION SELECT node_id, 'path', m, 8 * m FROM n, (VALUES (1), (2)) t(m) WHERE contains(lower(file_path), 'apps'))
SELECT id, CAST(sum(w) + 10 AS BIGINT) AS score FROM r GROUP BY id""",
    "search_by_role": "SELECT DISTINCT node_id FROM node_snapshots WHERE list_contains(classification_roles, 'entry-point')",
    "view_lineage": """
WITH n AS (SELECT node_id, label FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY recorded_at, label) AS r FROM node_registry) WHERE r = 1)
SELECT DISTINCT edge_id, e.kind, s.label AS source_label, t.label AS target_label, s.label IS NOT NULL AND t.label IS NOT NULL AS complete
FROM lineage_edges e LEFT JOIN n s ON s.node_id = e.source LEFT JOIN n t ON t.node_id = e.target""",
    "lineage_neighborhood": """
WITH e AS (SELECT DISTINCT source, target FROM lineage_edges WHERE source IS NOT NULL AND target IS NOT NULL),
st AS (SELECT source AS here, target AS there FROM e UNION ALL SELECT target, source FROM e),
l0 AS (SELECT id, 0 AS level FROM (SELECT target AS id, count(*) AS n FROM e GROUP BY target ORDER BY n DESC, id LIMIT 1)),
l1 AS (SELECT * FROM l0 UNION ALL SELECT DISTINCT there, 1 FROM st WHERE here IN (SELECT id FROM l0) AND there NOT IN (SELECT id FROM l0)),
l2 AS (SELECT * FROM l1 UNION ALL SELECT DISTINCT there, 2 FROM st WHERE here IN (SELECT id FROM l1 WHERE level = 1) AND there NOT IN (SELECT id FROM l1))
SELECT id, level FROM l2""",
    "lineage_nodes_upsert": f"""
WITH r AS (SELECT DISTINCT node_id, label, file_path, confidence, recorded_at FROM node_registry),
a AS (SELECT node_id, max({_C}) AS r, min((recorded_at, label)) FILTER (label IS NOT NULL) AS l, coalesce(string_agg(DISTINCT file_path, '|' ORDER BY file_path), '') AS files FROM r GROUP BY node_id)
SELECT node_id, l[2] AS label, CASE r WHEN 4 THEN 'explicit' WHEN 3 THEN 'inferred-static' WHEN 2 THEN 'partial' WHEN 1 THEN 'unknown' END AS confidence, files FROM a""",
    "api_impact": """
WITH h AS (SELECT DISTINCT unresolved_no, node_id FROM (SELECT unresolved_no, unnest(candidate_node_ids) AS node_id FROM api_unresolved)
  WHERE node_id IN (SELECT node_id FROM node_registry WHERE deleted_at IS NOT NULL))
SELECT node_id, unresolved_no, count(*) OVER (PARTITION BY node_id) AS impacts, row_number() OVER (PARTITION BY node_id ORDER BY unresolved_no) <= 64 AS listed FROM h""",
    "unresolved_qualification": """
WITH i AS (SELECT DISTINCT unresolved_no, node_id FROM (SELECT unresolved_no, unnest(candidate_node_ids) AS node_id FROM api_unresolved)),
k AS (SELECT unresolved_no, count(*) AS n FROM i WHERE node_id IN (SELECT node_id FROM node_registry) GROUP BY unresolved_no),
a AS (SELECT DISTINCT unresolved_no FROM api_unresolved)
SELECT unresolved_no, CASE coalesce(n, 0) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS qualification, coalesce(n, 0) AS n FROM a LEFT JOIN k USING (unresolved_no)""",
    "semantic_summary_diff": """
WITH best AS (SELECT repo, snapshot_no, max(delivery_no) AS delivery_no FROM snapshot_deliveries WHERE status = 'complete' GROUP BY repo, snapshot_no),
e AS (SELECT *, min(snapshot_no) OVER (PARTITION BY repo) AS lo, max(snapshot_no) OVER (PARTITION BY repo) AS hi FROM best),
c AS (SELECT repo, kind, count(DISTINCT CASE WHEN snapshot_no = lo THEN node_id END) AS first_nodes, count(DISTINCT CASE WHEN snapshot_no = hi THEN node_id END) AS last_nodes
  FROM node_snapshots JOIN e USING (repo, snapshot_no, delivery_no) WHERE snapshot_no IN (lo, hi) GROUP BY repo, kind)
SELECT repo, kind, first_nodes, last_nodes FROM c WHERE first_nodes <> last_nodes""",
    "regression_evaluation": """
WITH p AS (SELECT *, 'part:' || p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY 'part:' || p_partkey) AS rank FROM part WHERE p_name IS NOT NULL AND p_partkey IS NOT NULL),
x AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS suite, 'required' AS category, rank <= 15 AS passed FROM p WHERE p_size > 25
  UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END, 'forbidden', rank > 15 FROM p WHERE p_size = 1
  UNION ALL SELECT 'all', 'at-most', count(*) <= 12 FROM p GROUP BY p_name)
SELECT suite, category, CAST(count_if(passed) AS BIGINT) AS passed, count(*) AS expected, round(count_if(passed) / count(*), 6) AS rate, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'REGRESSION' END AS verdict FROM x GROUP BY suite, category""",
    "usage_owner_pairs": """
SELECT DISTINCT o.source AS owner, u.source AS via, u.target AS used FROM lineage_edges u JOIN lineage_edges o ON o.target = u.source
WHERE u.kind IN ('reads-field', 'renders-field') AND o.kind IN ('creates-view-model', 'derives-field', 'passes-prop') AND o.source IS NOT NULL AND u.target IS NOT NULL""",
    "overlapping_blocks": """
WITH r AS (SELECT DISTINCT e.file_path AS path, e.line AS line, edge_no FROM (SELECT edge_no, unnest(evidence_refs) AS e FROM (SELECT DISTINCT edge_no, evidence_refs FROM lineage_edges)) WHERE e.file_path IS NOT NULL AND e.line IS NOT NULL)
SELECT path, line, edge_no, (SELECT count(*) FROM r b WHERE b.path = a.path AND b.line BETWEEN a.line - 5 AND a.line + 5) - 1 AS near FROM r a""",
}
