"""Queries over applications: entries, evidence, lineage, reachability, Android edges, whole indexes; with oracle SQL.

Where the given tables hold no such sources, inputs are derived from them by a plain rule, so SQL can say what must come
out: a manifest is written from suppliers and read back, routes and texts from parts and orders are joined again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import android, entries, evidence, graph, lineage, reachability
from weftline.plans.engine import CodeIndex
from weftline.plans.extract_queries import _facts
from weftline.plans.graph_queries import _G, edges, nodes
from weftline.session import materialize, scratch, ship, table
from weftline.sources import extract
from weftline.sources.artifacts import ArtifactStore


# classification of symbols
def _symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, d, "node_snapshots", "repo", "node_id", "kind", "exported", "classification_roles", "route_metadata").filter(F.col("kind") == "symbol")
    n = n.withColumn("id", F.concat_ws("#", "repo", "node_id"))
    sure = F.when(F.col("exported"), "certain").when(~F.col("exported"), "likely")
    known = n.select("id", F.explode("classification_roles").alias("role"), sure.alias("confidence"))
    reach = n.filter(F.col("route_metadata").isNotNull()).select("id", F.lit("route-handler").alias("role"), F.col("route_metadata").contains('"auth"').alias("gated"))
    return n.select("id"), known, reach


def symbol_classification(spark: SparkSession, d: str) -> DataFrame:
    got = entries.symbol_entries(*_symbols(spark, d))
    return got.select("id", F.array_join("roles", ",").alias("roles"), "uncertainty", "conflict", "evidence", "guidance", "readiness", F.array_join("risks", ",").alias("risks"))


def component_role_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entries of registry components with the kinds of their edges as roles; a risk where an edge's target is not settled."""
    reg = table(spark, d, "node_registry", "node_id", "node_kind").distinct()
    none = F.array().cast("array<string>")
    base = reg.select(F.col("node_id").alias("id"), F.array("node_kind").alias("roles"), none.alias("risks"))
    e = table(spark, d, "lineage_edges", "source", "kind", "confidence")
    comp = e.filter(F.col("source").isNotNull() & F.col("kind").isNotNull()).select(F.col("source").alias("id"), F.col("kind").alias("role"))
    dep = e.select("source", (F.col("confidence") == "partial").alias("candidate"))
    got = entries.component_roles(base.dropDuplicates(["id"]), comp, dep)
    return got.select("id", F.array_join("roles", ",").alias("roles"), F.array_join("risks", ",").alias("risks"))


def classification_invariants(spark: SparkSession, d: str) -> DataFrame:
    """How many registry rows, read as entries, keep each rule of classification."""
    r = table(spark, d, "node_registry", "node_kind", "label", "file_path", "confidence", "deleted_at").filter(F.col("node_kind").isNotNull())
    c = F.col("confidence")
    tier = F.when(c == "explicit", "certain").when(c == "inferred-static", "likely").when(c == "partial", "possible").otherwise("unknown")
    rows = r.select(
        F.array(F.when(F.col("node_kind") == "rendered-field", "generated-file").otherwise(F.col("node_kind"))).alias("roles"), tier.alias("uncertainty"), F.when(F.col("file_path").isNotNull(), 1).otherwise(0).alias("evidence"),
        F.when(F.col("node_kind") == "rendered-field", "generated-do-not-edit").when(F.col("deleted_at").isNotNull(), "uncertain").otherwise("inspect-before-edit").alias("guidance"), F.when(F.col("label").contains("a"), 1).otherwise(0).alias("warnings"),
    )
    return entries.invariants(rows)


def entity_field_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Labels of data fields, and three that nothing has, looked up as Entity.field in the registry."""
    r = table(spark, d, "node_registry", "node_id", "label", "node_kind").filter((F.col("node_kind") == "data-field") & F.col("label").isNotNull() & F.col("node_id").isNotNull())
    fields = r.select(F.col("node_id").alias("id"), F.substring_index("label", ".", 1).alias("entity"), F.substring_index("label", ".", -1).alias("field")).distinct()
    none = spark.createDataFrame([("No.such",), ("Nothing",), (" ",)], "selector string")
    asked = fields.select(F.concat_ws(".", "entity", "field").alias("selector")).unionByName(r.filter(F.length("node_id") % 3 == 0).select(F.col("node_id").alias("selector"))).unionByName(none)
    return entries.field_selector(fields, asked).withColumn("candidates", F.array_join("candidates", ","))


# contexts
def _evidence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "node_snapshots", "repo", "node_id", "path", "label", "line").filter(F.col("repo").isNotNull() & F.col("node_id").isNotNull())
    kinds = evidence.group_kinds(F.coalesce("path", F.lit("")), F.coalesce("label", F.lit("")))
    return n.select(F.explode(kinds).alias("grp"), F.concat_ws("#", "repo", "node_id").alias("id"), F.coalesce("line", F.lit(0)).alias("score"), "path")


LIMITS = [("owners", 8), ("contracts", 8), ("validators-and-constants", 6), ("errors", 6), ("schemas-and-serializers", 6), ("related-tests", 10), ("mocks", 4), ("factories", 4), ("fixtures", 4), ("dependencies", 5)]


def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame(LIMITS, "grp string, most int")
    return evidence.evidence_groups(_evidence(spark, d), limits)[0].select("grp", "id", "score", "rank")


def evidence_group_summary(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame(LIMITS, "grp string, most int")
    return evidence.evidence_groups(_evidence(spark, d), limits)[1]


CATEGORIES = {"owners": "production", "contracts": "contract", "validators-and-constants": "contract", "errors": "oracle", "schemas-and-serializers": "oracle", "related-tests": "test"}


def responsibility_mapping(spark: SparkSession, d: str) -> DataFrame:
    """What each repository is asked to show, a responsibility for each symbol kind and file extension, against its groups."""
    n = table(spark, d, "node_snapshots", "repo", "symbol_kind", "language", "path", "label").filter(F.col("repo").isNotNull())
    asked = n.select(F.col("repo").alias("scope"), F.explode(F.array("symbol_kind", "language")).alias("responsibility")).filter(F.col("responsibility").isNotNull())
    asked = asked.select("*", F.length("responsibility").alias("position"), F.col("responsibility").startswith("c").alias("critical")).distinct()
    kinds = evidence.group_kinds(F.coalesce("path", F.lit("")), F.coalesce("label", F.lit("")))
    names = F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p])
    have = n.select(F.col("repo").alias("scope"), F.explode(kinds).alias("grp")).select("scope", names[F.col("grp")].alias("category")).filter(F.col("category").isNotNull()).distinct()
    return evidence.responsibilities(asked, have, most=5)


def request_merge(spark: SparkSession, d: str) -> DataFrame:
    """One request from a caller's and a file's fields; a small table made on the driver."""
    got = evidence.merge_request({"query": "Retry  POLICY", "limit": 5, "roots": ["b", "a"]}, {"query", "roots"}, {"query": "retry policy", "mode": "subsystem", "roots": ["a", "b", "a"]}, {"query": None, "mode": "none", "limit": 20, "roots": [], "role": "none"})
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v), s) for k, (v, s) in got.items()], "field string, value string, source string")


# words of a query
def term_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What paths, names, routes and words of the tables look like as query terms."""
    reg = table(spark, d, "node_registry", "label", "file_path", "node_kind")
    path = reg.filter(F.col("file_path").rlike(r"^[\w./\-]+\.(ts|tsx|js|jsx)$")).select(F.col("file_path").alias("word"))
    route = reg.filter(F.col("node_kind") == "framework-route").select(F.substring_index("label", " ", -1).alias("word"))
    plain = table(spark, d, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("word"))
    words = path.unionByName(route).unionByName(plain).filter(F.col("word").isNotNull()).distinct()
    return words.select("word", X.term_kinds(F.col("word")).alias("kind"))


def plain_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries without their connectors."""
    p = table(spark, d, "part", "p_name").distinct()
    asked = p.select(F.concat(F.lit("how the "), F.col("p_name"), F.lit(" is used in \"the shop\"")).alias("asked")).unionByName(spark.createDataFrame([("the",), ("",)], "asked string"))
    return asked.select("asked", X.without_connectors_column(F.col("asked")).alias("plain"))


# lineage, reachability, Android
def lineage_edges_built(spark: SparkSession, d: str) -> DataFrame:
    """Lineage built from a source file written for each part type: a model, a transformation, a component and its use."""
    ship(spark)
    t = table(spark, d, "part", "p_type").filter(F.col("p_type").isNotNull()).distinct().select(F.concat(F.lit("M"), F.regexp_replace("p_type", r"\W", "")).alias("n")).distinct()
    code = F.concat(
        F.lit("export interface "), "n", F.lit(" { name: string; size: number }\nconst one: "), "n", F.lit(" = load();\nfunction toView(x: "), "n",
        F.lit(") { return { title: x.name, big: x.size }; }\nfunction Card({ title }: P) { return <b>{title}</b>; }\nconst made = toView(one);\nconst page = <Card title={made.title} raw={one.size} />;\n"),
    )
    files = t.select(F.concat(F.lit("src/"), "n", F.lit(".tsx")).alias("path"), code.alias("content"))
    facts = materialize(spark, extract.extract_files(files, [], records=("lineage", "model", "model_field")), "lineage")
    return lineage.build(facts, lineage.models_of(facts))[1].select("id", "kind", "source", "target", "confidence", F.array_join("evidence", ",").alias("evidence"))


def _reach(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts of an application that the star tables stand for: a file for each nation, its customers' segments as texts."""
    nation = table(spark, d, "nation", "n_nationkey", "n_name").withColumn("path", F.concat(F.lit("src/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(".tsx")))
    cust = table(spark, d, "customer", "c_nationkey", "c_mktsegment").filter(F.col("c_mktsegment").isNotNull()).distinct().join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = table(spark, d, "supplier", "s_nationkey", "s_name").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    fact = lambda record, name, kind: (F.lit(record).alias("record"), name.alias("name"), F.lit(kind).alias("kind"), "path")
    test = F.replace("path", F.lit(".tsx"), F.lit(".spec.tsx")).alias("path")
    rows = nation.select(*fact("route", F.concat(F.lit("/Nation/"), "n_nationkey"), "GET"))
    rows = rows.unionByName(cust.select(*fact("ui_string", F.initcap("c_mktsegment"), "jsx"))).unionByName(supp.select(*fact("storage", F.col("s_name"), "localStorage")))
    rows = rows.unionByName(nation.select(F.lit("test").alias("record"), F.concat(F.lit("shows "), "n_name").alias("name"), F.lit("test").alias("kind"), test))
    rows = rows.unionByName(cust.filter(F.col("c_nationkey") % 2 == 0).select(F.lit("locator").alias("record"), F.initcap("c_mktsegment").alias("name"), F.lit("getByText").alias("kind"), test))
    return rows, nation.select(F.col("n_name").alias("component"), "path")


def reach_facts_merged(spark: SparkSession, d: str) -> DataFrame:
    return reachability.reach_facts(_reach(spark, d)[0]).withColumn("files", F.array_join("files", ","))


def reach_edges_built(spark: SparkSession, d: str) -> DataFrame:
    facts, comp = _reach(spark, d)
    return reachability.reach_edges(reachability.reach_facts(facts), comp)


def reach_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold `build`, and what touches them."""
    facts, comp = _reach(spark, d)
    known = reachability.reach_facts(facts)
    return reachability.related(reachability.reach_edges(known, comp), reachability.find(known, "ui", "BUILD")).select("id")


def test_infrastructure(spark: SparkSession, d: str) -> DataFrame:
    """What the test files of all repositories import."""
    return reachability.test_infrastructure(_facts(spark, d, "import"), X.is_test_path(F.col("path")))


def _manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A manifest for each nation, its suppliers as activities; and the classes that some of them name."""
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").filter(F.col("s_nationkey").isNotNull())
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("."), F.lit("S"), "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("S"), "s_suppkey")).otherwise(F.concat(F.lit("com.n"), "s_nationkey", F.lit(".S"), "s_suppkey"))
    one = F.concat(F.lit('<activity android:name="'), name, F.lit('"/>'))
    per = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("body"))
    text = F.concat(F.lit('<manifest xmlns:android="a" package="com.n'), "s_nationkey", F.lit('"><uses-permission android:name="p.USE"/><uses-permission android:name="p.N'), F.col("s_nationkey") % 3, F.lit('"/><permission android:name="p.N1"/><application>'), "body", F.lit("</application></manifest>"))
    files = per.select(F.concat(F.lit("app"), "s_nationkey", F.lit("/AndroidManifest.xml")).alias("path"), text.alias("content"), F.concat(F.lit("com.n"), "s_nationkey").alias("package"))
    classes = s.filter(F.col("s_suppkey") % 2 == 0).select(F.concat(F.lit("com.n"), "s_nationkey", F.lit(".S"), "s_suppkey").alias("fqcn"), F.concat(F.lit("symbol:S"), "s_suppkey").alias("node_id"))
    return files, classes


def android_manifest_edges(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    files, classes = _manifests(spark, d)
    elements = extract.extract_files(files.select("path", "content"), [])
    return android.manifest_edges(elements, files.select("path", "package"), classes).select("source", "target", "kind", "candidate")


def android_permission_edges(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    elements = extract.extract_files(_manifests(spark, d)[0].select("path", "content"), [])
    return android.permission_edges(elements).select("source", "target", "kind")


def gradle_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules and their dependencies, of a settings file and a build file written for each region and nation."""
    ship(spark)
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey").filter(F.col("n_regionkey").isNotNull())
    settings = n.groupBy("n_regionkey").agg(F.concat(F.lit("include("), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('":n'), "n_nationkey", F.lit('"')))), ", "), F.lit(")\n")).alias("content")).select(F.concat(F.lit("r"), "n_regionkey", F.lit("/settings.gradle.kts")).alias("path"), "content")
    build = n.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/build.gradle.kts")).alias("path"), F.concat(F.lit('plugins { id("com.android.library") }\ndependencies {\n  implementation(project(":n'), F.col("n_nationkey") + 1, F.lit('"))\n  api("org.x:y:1.'), "n_nationkey", F.lit('")\n}\n')).alias("content"))
    facts = extract.extract_files(settings.unionByName(build), [])
    return android.gradle_edges(facts).select("source", "target", "kind", "status")


def graph_enriched(spark: SparkSession, d: str) -> DataFrame:
    """The order graph with the reachability of nations appended: how many nodes and edges of each kind."""
    facts, comp = _reach(spark, d)
    known = reachability.reach_facts(facts)
    more = known.select("id", "kind", F.col("value").alias("label")).unionByName(comp.select(F.concat(F.lit("component:"), "component").alias("id"), F.lit("component").alias("kind"), F.col("component").alias("label")))
    n, e = graph.enrich(nodes(spark, d), edges(spark, d), more, reachability.reach_edges(known, comp))
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(n, "node").unionByName(count(e, "edge"))


# whole indexes
def _as_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files", "repo", "path", "content").filter(F.col("content").isNotNull() & F.col("path").isNotNull()).dropDuplicates(["repo", "path"])
    return f.select(F.concat_ws("/", "repo", "path").alias("rel_path"), F.encode("content", "utf-8").alias("content"), F.length(F.encode("content", "utf-8")).cast("long").alias("size_bytes"))


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges by kind of a whole index over all stored files."""
    ix = CodeIndex(spark, scratch(spark, "index")).build_from(_as_files(spark, d))
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(ix.nodes, "node").unionByName(count(ix.edges, "edge"))


def artifact_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Tables published, sealed, verified by their files' sha-256, and read back."""
    store = ArtifactStore(spark, scratch(spark, "artifacts"))
    names = ("region", "nation", "supplier")
    store.publish({n: (table(spark, d, n), "1") for n in names})
    store.seal("f1")
    status, reason = store.trusted(names, "f1", ["1"])
    other, why = store.trusted(names, "f2", ["1"])
    out = spark.createDataFrame([("f1", status, reason), ("f2", other, why)], "fingerprint string, status string, reason string").withColumn("rows", F.lit(None).cast("bigint"))
    for n in names:
        got = store.read(n, ["1"], verify=True).agg(F.count("*").alias("rows"))
        out = out.unionByName(got.select(F.lit(n).alias("fingerprint"), F.lit("read").alias("status"), F.lit("").alias("reason"), "rows"))
    return out


QUERIES = {f.__name__: f for f in (
    symbol_classification, component_role_merge, classification_invariants, entity_field_selectors, evidence_groups, evidence_group_summary, responsibility_mapping,
    request_merge, term_kinds, plain_queries, lineage_edges_built, reach_facts_merged, reach_edges_built, reach_found, test_infrastructure,
    android_manifest_edges, android_permission_edges, gradle_modules, graph_enriched, index_summary, artifact_catalog,
)}

_TEST = r"regexp_matches({p}, '(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go|rs)$', 'i')"
_GROUPS = r"""
WITH n0 AS (SELECT repo, node_id, coalesce(path, '') AS path, path AS p0, coalesce(label, '') AS label, coalesce(line, 0) AS line, symbol_kind, language FROM node_snapshots WHERE repo IS NOT NULL),
n AS (SELECT *, string_split(path, '/')[-1] AS base, TEST AS test FROM n0),
g AS (SELECT *, unnest(list_filter([
  CASE WHEN regexp_matches(base, '(command|registry|dispatcher|adapter|analyzer|builder|producer|manager)', 'i') AND NOT test THEN 'owners' END,
  CASE WHEN regexp_matches(base, '(types?|schema|valid|constant|error)', 'i') AND NOT test THEN 'contracts' END,
  CASE WHEN regexp_matches(base || ' ' || label, 'valid|constant', 'i') AND NOT test THEN 'validators-and-constants' END,
  CASE WHEN regexp_matches(base || ' ' || label, 'error', 'i') AND NOT test THEN 'errors' END,
  CASE WHEN regexp_matches(base || ' ' || label, 'schema', 'i') AND NOT test THEN 'schemas-and-serializers' END,
  CASE WHEN test THEN 'related-tests' END, CASE WHEN test AND regexp_matches(base, '(mock|stub|fake|spy)', 'i') THEN 'mocks' END,
  CASE WHEN test AND regexp_matches(base, '(factory|builder|createtest|maketest)', 'i') THEN 'factories' END, CASE WHEN test AND regexp_matches(path, 'fixture', 'i') THEN 'fixtures' END],
  lambda x: x IS NOT NULL)) AS grp FROM n)""".replace("TEST", _TEST.format(p="path"))
_LIMITS = "(VALUES " + ", ".join(f"('{g}', {n})" for g, n in LIMITS) + ") AS l(grp, most)"
_BEST = _GROUPS + ", b AS (SELECT grp, repo || '#' || node_id AS id, max(line) AS score, min(p0) AS path FROM g WHERE node_id IS NOT NULL GROUP BY 1, 2)"
_NATION = """
WITH nt AS (SELECT n_nationkey, n_name, 'src/' || lower(replace(n_name, ' ', '_')) || '.tsx' AS path FROM nation),
cu AS (SELECT DISTINCT c_nationkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, path FROM customer JOIN nt ON c_nationkey = n_nationkey WHERE c_mktsegment IS NOT NULL),
su AS (SELECT s_name, path FROM supplier JOIN nt ON s_nationkey = n_nationkey),
ft AS (SELECT 'route:/nation/' || n_nationkey AS id, 'route' AS kind, '/Nation/' || n_nationkey AS value, 'route' AS marker, 'high' AS confidence, path FROM nt
  UNION ALL SELECT 'ui:text:' || lower(seg), 'ui', seg, 'text', 'medium', path FROM cu UNION ALL SELECT 'storage:localStorage:' || s_name, 'storage', s_name, 'localStorage', 'high', path FROM su
  UNION ALL SELECT 'ui:test:' || regexp_replace(lower(trim('shows ' || n_name)), '\\s+', '-', 'g'), 'ui', 'shows ' || n_name, 'test', 'high', replace(path, '.tsx', '.spec.tsx') FROM nt
  UNION ALL SELECT 'ui:getByText:' || lower(seg), 'ui', seg, 'getByText', 'high', replace(path, '.tsx', '.spec.tsx') FROM cu WHERE c_nationkey % 2 = 0),
re AS (SELECT DISTINCT 'route:/nation/' || n_nationkey AS source, 'component:' || n_name AS target, 'route-renders-component' AS kind FROM nt
  UNION SELECT 'component:' || n_name, 'ui:text:' || lower(seg), 'component-shows-ui' FROM nt JOIN cu ON c_nationkey = n_nationkey
  UNION SELECT 'storage:localStorage:' || s_name, 'ui:text:' || lower(seg), 'storage-gates-ui' FROM su JOIN cu ON cu.path = su.path
  UNION SELECT 'ui:test:' || regexp_replace(lower('shows ' || n_name), '\\s+', '-', 'g'), 'ui:text:' || lower(seg), 'test-covers-ui' FROM nt JOIN cu ON c_nationkey = n_nationkey WHERE c_nationkey % 2 = 0),
rx AS (SELECT source, target, kind, source || '--' || kind || '-->' || target AS id FROM re)""".replace("\\\\", "\\")
_SUPPLY = """
WITH s AS (SELECT s_suppkey, s_nationkey, 'app' || s_nationkey || '/AndroidManifest.xml' AS path, 'com.n' || s_nationkey || '.S' || s_suppkey AS fqcn FROM supplier WHERE s_nationkey IS NOT NULL)"""
SQL = {
    "symbol_classification": r"""
WITH n AS (SELECT repo || '#' || node_id AS id, exported, classification_roles, route_metadata FROM node_snapshots WHERE kind = 'symbol'),
c AS (SELECT id, unnest(classification_roles) AS role, CASE WHEN exported THEN 3 WHEN NOT exported THEN 2 ELSE 1 END AS r, CAST(NULL AS BOOLEAN) AS gated FROM n
  UNION ALL SELECT id, 'route-handler', CASE WHEN contains(route_metadata, '"auth"') THEN 2 ELSE 1 END, contains(route_metadata, '"auth"') FROM n WHERE route_metadata IS NOT NULL),
p AS (SELECT id, role, max(r) AS r, bool_or(gated) AS gated FROM c WHERE id IS NOT NULL AND role IS NOT NULL GROUP BY id, role),
b AS (SELECT id, max(r) AS best, bool_or(gated) AS gated, count(*) AS evidence FROM p GROUP BY id),
k AS (SELECT p.id, list_sort(list(role)) AS roles, any_value(best) AS best, any_value(b.gated) AS gated, any_value(evidence) AS evidence FROM p JOIN b ON b.id = p.id AND p.r = b.best GROUP BY p.id),
e AS (SELECT i.id, coalesce(roles, []) AS roles, coalesce(evidence, 0) AS evidence, gated, len(coalesce(roles, [])) > 1 AS conflict,
  CASE WHEN roles IS NULL THEN 'unknown' WHEN len(roles) > 1 OR best = 1 THEN 'possible' WHEN best = 2 THEN 'likely' ELSE 'certain' END AS uncertainty FROM (SELECT DISTINCT id FROM n WHERE id IS NOT NULL) i LEFT JOIN k ON k.id = i.id)
SELECT id, array_to_string(roles, ',') AS roles, uncertainty, conflict, evidence,
  CASE WHEN uncertainty = 'unknown' THEN 'uncertain' ELSE 'inspect-before-edit' END AS guidance,
  CASE WHEN conflict THEN 'risky-assumption' WHEN uncertainty IN ('possible', 'unknown') THEN 'needs-more-context' ELSE 'ready' END AS readiness,
  concat_ws(',', CASE WHEN list_contains(roles, 'route-handler') THEN 'public-contract-risk' END, CASE WHEN list_contains(roles, 'route-handler') AND gated = false THEN 'unreachable-ui-risk' END) AS risks FROM e""",
    "component_role_merge": """
WITH r AS (SELECT node_id AS id, min(node_kind) AS k FROM node_registry GROUP BY node_id),
m AS (SELECT source AS id, list(DISTINCT kind) AS more FROM lineage_edges WHERE source IS NOT NULL AND kind IS NOT NULL GROUP BY source),
x AS (SELECT source AS id, bool_or(confidence = 'partial') AS risky FROM lineage_edges GROUP BY source)
SELECT r.id, array_to_string(list_sort(list_distinct(list_concat([k], coalesce(more, [])))), ',') AS roles, CASE WHEN more IS NOT NULL AND risky THEN 'wrong-layer-risk' ELSE '' END AS risks
FROM r LEFT JOIN m ON m.id = r.id LEFT JOIN x ON x.id = r.id""",
    "classification_invariants": """
WITH r AS (SELECT node_kind, label, file_path, deleted_at, CASE confidence WHEN 'explicit' THEN 'certain' WHEN 'inferred-static' THEN 'likely' WHEN 'partial' THEN 'possible' ELSE 'unknown' END AS t FROM node_registry WHERE node_kind IS NOT NULL)
SELECT 'certain-has-evidence' AS invariant, count_if(t = 'certain') AS checked, count_if(t = 'certain' AND file_path IS NULL) AS violated FROM r
UNION ALL SELECT 'unknown-is-uncertain', count_if(t = 'unknown'), count_if(t = 'unknown' AND (deleted_at IS NULL OR node_kind = 'rendered-field')) FROM r
UNION ALL SELECT 'generated-is-not-edited', count_if(node_kind = 'rendered-field'), 0 FROM r
UNION ALL SELECT 'doubt-carries-a-warning', count_if(t IN ('possible', 'unknown')), count_if(t IN ('possible', 'unknown') AND NOT coalesce(contains(label, 'a'), false)) FROM r""",
    "evidence_groups": _BEST + f", k AS (SELECT b.*, most, row_number() OVER (PARTITION BY b.grp ORDER BY score DESC, path NULLS LAST, id) AS rank FROM b JOIN {_LIMITS} ON l.grp = b.grp) SELECT grp, id, score, rank FROM k WHERE rank <= most",
    "evidence_group_summary": _BEST + f", c AS (SELECT grp, count(*) AS n FROM b GROUP BY grp) SELECT l.grp, coalesce(n, 0) AS available, least(coalesce(n, 0), most) AS selected, coalesce(n, 0) - least(coalesce(n, 0), most) AS dropped FROM {_LIMITS} LEFT JOIN c ON c.grp = l.grp",
    "responsibility_mapping": _GROUPS + """
, h AS (SELECT DISTINCT repo, CASE grp WHEN 'owners' THEN 'production' WHEN 'contracts' THEN 'contract' WHEN 'validators-and-constants' THEN 'contract' WHEN 'errors' THEN 'oracle' WHEN 'schemas-and-serializers' THEN 'oracle' WHEN 'related-tests' THEN 'test' END AS c FROM g),
a AS (SELECT DISTINCT repo AS scope, unnest([symbol_kind, language]) AS r FROM n), o AS (SELECT *, length(r) AS position, starts_with(r, 'c') AS critical FROM a WHERE r IS NOT NULL),
hl AS (SELECT repo, list(c) AS has FROM h WHERE c IS NOT NULL GROUP BY repo),
m AS (SELECT o.*, list_filter(['production', 'contract', 'test', 'oracle'], lambda x: NOT list_contains(coalesce(has, []), x)) AS missing FROM o LEFT JOIN hl ON hl.repo = o.scope)
SELECT scope, r AS responsibility, position, CASE len(missing) WHEN 0 THEN 'mapped' WHEN 4 THEN 'unmapped' ELSE 'partially-mapped' END AS status, array_to_string(missing, ',') AS missing,
  row_number() OVER (PARTITION BY scope ORDER BY critical DESC, r) <= 5 AS retained FROM m""",
    "request_merge": "SELECT * FROM (VALUES ('query', 'Retry  POLICY', 'equivalent-duplicate'), ('mode', 'subsystem', 'request-file'), ('limit', '5', 'default'), ('roots', 'b,a', 'equivalent-duplicate'), ('role', 'none', 'default')) AS t(field, value, source)",
    "reach_facts_merged": _NATION + " SELECT id, min(kind) AS kind, min(value) AS value, min(marker) AS marker, min(confidence) AS confidence, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM ft GROUP BY id",
    "reach_edges_built": _NATION + " SELECT id, source, target, kind FROM rx",
    "reach_found": _NATION + " SELECT id FROM rx WHERE contains(source, 'ui:text:build') OR contains(target, 'ui:text:build') OR contains(source, 'ui:getByText:build')",
    "lineage_edges_built": r"""
WITH m AS (SELECT DISTINCT 'M' || regexp_replace(p_type, '\W', '', 'g') AS n FROM part WHERE p_type IS NOT NULL),
f AS (SELECT 'src/' || n || '.tsx' AS p, 'lineage:data-field:' || n || '.' AS d FROM m),
e AS (SELECT 'reads-field' AS kind, d || 'name' AS source, 'lineage:transformation:' || p || '#toView' AS target, p || ':3' AS evidence FROM f UNION ALL SELECT 'reads-field', d || 'size', 'lineage:transformation:' || p || '#toView', p || ':3' FROM f
  UNION ALL SELECT 'creates-view-model', 'lineage:transformation:' || p || '#toView', 'lineage:view-model:' || p || '#toView.' || x, p || ':3' FROM f, (VALUES ('title'), ('big')) AS v(x)
  UNION ALL SELECT 'derives-field', 'lineage:view-model:' || p || '#toView.' || x, 'lineage:view-model:' || p || '#made.' || x, p || ':5' FROM f, (VALUES ('title'), ('big')) AS v(x)
  UNION ALL SELECT 'passes-prop', 'lineage:view-model:' || p || '#made.title', 'lineage:component-prop:' || p || '#Card.title', p || ':6' FROM f
  UNION ALL SELECT 'passes-prop', d || 'size', 'lineage:component-prop:' || p || '#Card.raw', p || ':6' FROM f
  UNION ALL SELECT 'renders-field', 'lineage:component-prop:' || p || '#Card.title', 'lineage:rendered-field:' || p || '#Card.title', p || ':4' FROM f)
SELECT 'lineage-edge:' || kind || ':' || source || '->' || target AS id, kind, source, target, 'explicit' AS confidence, evidence FROM e""",
    "android_manifest_edges": _SUPPLY + """
SELECT 'file:' || path AS source, 'android-component:' || path || '#' || fqcn AS target, 'manifest-declares-component' AS kind, false AS candidate FROM s
UNION ALL SELECT DISTINCT 'android-component:' || path || '#' || fqcn, 'symbol:S' || s_suppkey, 'manifest-component-resolves-to-source', false FROM s WHERE s_suppkey % 2 = 0""",
    "android_permission_edges": _SUPPLY + """
, m AS (SELECT DISTINCT path, s_nationkey % 3 AS n FROM s)
SELECT 'file:' || path AS source, 'android-permission-reference:p.USE' AS target, 'manifest-uses-permission' AS kind FROM m
UNION ALL SELECT 'file:' || path, CASE WHEN n = 1 THEN 'android-permission:p.N1' ELSE 'android-permission-reference:p.N' || n END, 'manifest-uses-permission' FROM m""",
    "gradle_modules": """
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey IS NOT NULL)
SELECT 'file:r' || r || '/settings.gradle.kts' AS source, 'gradle-module:r' || r || ':n' || k AS target, 'project-includes-module' AS kind, 'resolved' AS status FROM n
UNION ALL SELECT 'gradle-module:r' || n.r || ':n' || n.k, 'gradle-module:r' || n.r || ':n' || (n.k + 1), 'module-depends-on-module', CASE WHEN o.k IS NULL THEN 'unresolved' ELSE 'resolved' END FROM n LEFT JOIN n o ON o.k = n.k + 1 AND o.r = n.r
UNION ALL SELECT 'gradle-module:r' || r || ':n' || k, 'gradle-artifact:org.x:y:1.' || k, 'module-depends-on-artifact', 'external' FROM n""",
    "graph_enriched": _NATION + _G.replace("\nWITH nodes", ", nodes").replace("WITH nodes", ", nodes", 1) + """
, nn AS (SELECT id, kind FROM nodes UNION ALL SELECT DISTINCT id, kind FROM ft UNION ALL SELECT 'component:' || n_name, 'component' FROM nt), ee AS (SELECT id, kind FROM edges UNION ALL SELECT id, kind FROM rx)
SELECT 'node' AS what, kind, count(*) AS n FROM nn GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM ee GROUP BY kind""",
    "artifact_catalog": """
SELECT 'f1' AS fingerprint, 'trusted' AS status, '' AS reason, CAST(NULL AS BIGINT) AS rows UNION ALL SELECT 'f2', 'incompatible', 'config-mismatch', NULL
UNION ALL SELECT 'region', 'read', '', count(*) FROM region UNION ALL SELECT 'nation', 'read', '', count(*) FROM nation UNION ALL SELECT 'supplier', 'read', '', count(*) FROM supplier""",
    "entity_field_selectors": """
WITH f AS (SELECT DISTINCT node_id AS id, string_split(label, '.')[1] AS entity, string_split(label, '.')[-1] AS field FROM node_registry WHERE node_kind = 'data-field' AND label IS NOT NULL AND node_id IS NOT NULL),
q AS (SELECT entity || '.' || field AS selector FROM f UNION SELECT id FROM f WHERE length(id) % 3 = 0 UNION SELECT unnest(['No.such', 'Nothing'])),
h AS (SELECT selector, id, 0 AS tier FROM q JOIN f ON f.id = q.selector UNION SELECT selector, id, 1 FROM q JOIN f ON f.entity || '.' || f.field = q.selector),
b AS (SELECT *, min(tier) OVER (PARTITION BY selector) AS best FROM h),
c AS (SELECT selector, count(DISTINCT id) AS n, min(id) AS id, list_sort(list(DISTINCT id)) AS ids FROM b WHERE tier = best GROUP BY selector)
SELECT DISTINCT q.selector, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN entity END AS entity, CASE WHEN n = 1 THEN field END AS field,
  coalesce(n, 0) AS n, coalesce(array_to_string(ids[:20], ','), '') AS candidates FROM q LEFT JOIN c ON c.selector = q.selector LEFT JOIN f ON f.id = c.id""",
    "term_kinds": r"""
WITH w AS (SELECT file_path AS word FROM node_registry WHERE regexp_full_match(file_path, '[\w./\-]+\.(ts|tsx|js|jsx)') UNION SELECT string_split(label, ' ')[-1] FROM node_registry WHERE node_kind = 'framework-route'
  UNION SELECT unnest(string_split(p_name, ' ')) FROM part)
SELECT word, CASE WHEN starts_with(word, '/') AND NOT regexp_matches(word, '[^\w\-:/{}\[\].*]') THEN 'route' WHEN regexp_full_match(word, '[\w.\-]+(/[\w.\-]+)+|[\w\-]+\.(tsx?|jsx?|py|kt|java|rs|json|md)') THEN 'path'
  WHEN regexp_matches(word, '[a-z0-9][A-Z]|_|\w\.\w|\(\)$') THEN 'symbol' ELSE 'word' END AS kind FROM w WHERE word IS NOT NULL""",
    "plain_queries": """
SELECT DISTINCT 'how the ' || p_name || ' is used in "the shop"' AS asked, 'how ' || p_name || ' is used "the shop"' AS plain FROM part UNION ALL SELECT 'the', 'the' UNION ALL SELECT '', ''""",
}
