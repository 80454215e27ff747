"""Ranking, focus, boosts, packing, resolution, metrics and event windows, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import context as C
from weftline.operators import resolve as V
from weftline.operators import rules as R
from weftline.plans.diff_queries import _RULES
from weftline.session import ship, table


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """A plain score of parts: the size and a bonus for red ones."""
    part = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    return part.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"),
                       (F.col("p_size") + F.when(F.col("p_name").startswith("red"), 13).otherwise(0)).alias("score"))


def candidate_retained_dropped(spark: SparkSession, d: str) -> DataFrame:
    return C.retained(_scores(spark, d), [F.desc("score"), "id"], 50).select("id", "score", "retained", "drop_reason")


def candidate_adjusted_scores(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files", "file_no", "path", "content").distinct()
    hits = files.select("file_no", "path", F.size(X.literal_pieces(F.col("content"), "Router")) - 1).toDF("file_no", "path", "hits")
    guidance = R.guidance(R.resolve(R.file_rules(F.col("path")))["classes"])
    return hits.select(
        "file_no",
        C.adjusted(F.col("path"), F.coalesce("hits", F.lit(0)), F.lit(1), "feature-add", guidance, F.lit("")).alias("feature_score"),
        C.adjusted(F.col("path"), F.coalesce("hits", F.lit(0)), F.lit(1), "subsystem", guidance, F.lit("src")).alias("subsystem_score"),
    )


def focus_confidence(spark: SparkSession, d: str) -> DataFrame:
    return C.focus(_scores(spark, d))


def near_tie_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.near_ties(_scores(spark, d))


def role_boosts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size")
    flags = {
        "focus_symbol": F.col("p_partkey") == 7, "focus_file": F.col("p_name") == "red widget", "changed_symbol": F.col("p_size") == 1,
        "changed_file": F.col("p_size") < 4, "owner_like": F.col("p_type") == "PROMO", "contract_like": F.col("p_type") == "STANDARD",
        "adjacent": F.col("p_partkey") % 3 == 0, "exact_query": F.col("p_name").contains("ring"), "closest_test": F.col("p_partkey") % 11 == 0,
    }
    return part.select("p_partkey", *[C.boost(r, flags).alias("b_" + r.replace("-", "_")) for r in C.BOOSTS])


def evidence_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Required-first allocation over the part types as groups."""
    g = table(spark, d, "part", "p_type").groupBy(F.col("p_type").alias("grp")).agg(F.count("*").alias("have"))
    order = F.row_number().over(Window.orderBy("grp"))
    groups = g.withColumn("position", order).select(
        "grp", "position", F.least(F.col("have"), F.col("position") * 9).alias("available"), F.lit(20).cast("long").alias("reservation"),
        F.lit(45).cast("long").alias("hard_limit"),
    )
    return C.allocate(groups)


def greedy_packing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order packed into 100 pieces and five blocks, in order of part."""
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").filter(F.col("l_orderkey").isNotNull())
    one = items.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("long").alias("lines"))
    return C.pack(one, "l_orderkey", "l_partkey", "lines", 100, 5)


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Windows of five lines round each fact of a lineage file, merged as they arrive."""
    ship(spark)
    refs = table(spark, d, "lineage_edges", "edge_no", "evidence_refs").distinct().select("edge_no", F.explode("evidence_refs").alias("e"))
    rows = refs.select(F.col("e.file_path").alias("path"), "edge_no", F.col("e.line").cast("long").alias("line")).filter(F.col("line").isNotNull() & F.col("path").isNotNull())
    return C.merge_sorted(rows.select("path", (F.col("line") - 5).alias("a"), (F.col("line") + 5).alias("b")), "path", "a", "b")


def interval_merge_in_order(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    refs = table(spark, d, "lineage_edges", "edge_no", "evidence_refs").distinct().select("edge_no", F.explode("evidence_refs").alias("e"))
    rows = refs.select(F.col("e.file_path").alias("path"), F.col("e.line").cast("long").alias("line"), "edge_no").filter(F.col("line").isNotNull() & F.col("path").isNotNull())
    ordered = rows.withColumn("o", F.struct("edge_no", "line"))
    return C.merge_in_order(ordered.select("path", "o", (F.col("line") - 5).alias("a"), (F.col("line") + 5).alias("b")), "path", "o", "a", "b")


def budget_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "repo", "text")
    n = F.size(X.lines(F.coalesce("text", F.lit(""))))
    per = docs.select("repo", n.alias("lines"))
    return per.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.coalesce(F.max("lines"), F.lit(0)).alias("longest"),
        F.count_if(F.col("lines") > 160).alias("truncated"),
    )


def condition_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which repositories have an owner, a contract and a test, and whether that is enough for a change."""
    files = table(spark, d, "source_files", "repo", "path").distinct()
    base = X.basename(F.col("path"))
    got = files.groupBy("repo").agg(
        F.bool_or(base.rlike(C.OWNER_LIKE)).alias("owner"), F.bool_or(base.rlike(C.CONTRACT_LIKE)).alias("contract"), F.bool_or(X.is_test_path(F.col("path"))).alias("test")
    )
    enough = F.when(F.col("owner") & F.col("contract"), "adequate").when(F.col("owner") | F.col("contract"), "partial").otherwise("inadequate")
    return got.select("repo", "owner", "contract", "test", enough.alias("adequacy"))


def focus_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names to nodes: one match is found, several are ambiguous, none is reported."""
    nodes = table(spark, d, "node_registry", "node_id", "label").distinct()
    wanted = nodes.select(F.substring_index("label", ".", -1).alias("name")).distinct()
    probe = wanted.unionByName(spark.createDataFrame([("noSuchName",)], "name string"))
    named = nodes.select("node_id", F.substring_index("label", ".", -1).alias("name"))
    return R.single_match(probe.join(named, "name", "left"), "name", "node_id")


def selector_cascade(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "node_registry", "node_id", "label").distinct()
    return V.cascade(nodes, "node_id", [
        ("exact", F.col("label") == "Mapper"), ("simple-name", F.substring_index("label", ".", -1).endswith("Mapper")), ("contains", F.col("label").contains("Mapper")),
    ])


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files", "repo", "path", "content").filter(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$")).distinct()
    spec = F.regexp_extract_all("content", F.lit(r"""(?:from\s+|require\()["']([^"']+)["']"""), F.lit(1))
    imports = files.select("repo", F.col("path").alias("importer"), F.explode(spec).alias("specifier"))
    return V.resolve_imports(imports, files, ["repo"])


def import_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Two-word specifiers, the words of part names and the next noun in order, against part names: none, one or many."""
    part = table(spark, d, "part", "p_partkey", "p_name")
    words = part.select(F.substring_index("p_name", " ", 1).alias("a"), F.substring_index("p_name", " ", -1).alias("n")).distinct()
    nouns = words.select("n").distinct()
    after = nouns.withColumn("next", F.coalesce(F.lead("n").over(Window.orderBy("n")), F.lit("cog")))  # a vocabulary, not rows
    asked = words.join(after, "n").select(F.explode(F.array(F.concat_ws(" ", "a", "n"), F.concat_ws(" ", "a", "next"))).alias("specifier")).distinct()
    hits = asked.join(part, asked["specifier"] == part["p_name"], "left").groupBy("specifier").agg(F.count("p_partkey").alias("n"))
    return hits.select("specifier", F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), "n")


ALIASES = [("@part/*", "lib/part/*"), ("@part/red ring", "lib/red-ring"), ("@*", "vendor/*"), ("@part/small*", "lib/small/*"), ("*", "any/*")]


def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part", "p_name").distinct().select(F.concat(F.lit("@part/"), F.col("p_name")).alias("specifier"))
    plain = table(spark, d, "part", "p_brand").distinct().select(F.col("p_brand").alias("specifier"))
    return V.resolve_aliases(names.unionByName(plain), spark.createDataFrame(ALIASES, "pattern string, replacement string"))


def _calls_and_ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events", "event_id", "user_id")
    calls = e.select(F.col("event_id").alias("call"), (F.col("user_id") * 3).alias("k"))
    ends = table(spark, d, "customer", "c_custkey", "c_nationkey").filter(F.col("c_nationkey") < 12)
    return calls, ends.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("endpoint"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") + 3).otherwise(F.col("c_custkey")).alias("k"))


def api_match_qualification(spark: SparkSession, d: str) -> DataFrame:
    """Client calls (users with an event type) against endpoints (customers of a nation) on one key."""
    return V.qualify(*_calls_and_ends(spark, d), ["k"])


def api_match_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every endpoint of every client call."""
    return V.candidates(*_calls_and_ends(spark, d), ["k"])


def relationship_query(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineage_edges", "edge_no", "kind", "confidence").distinct()
    return V.relationship_query(edges, {"kind": "relates-to", "confidence": "explicit"}, ["edge_no"], 64)


def import_target_proof(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "audit_files", "path").filter(F.col("path").isNotNull())
    return V.target_proof(want, table(spark, d, "source_files", "path"), ["src", "lib", "packages"])


def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "index_runs", "repo", "status")
    return runs.groupBy("repo").agg(
        F.count_if(F.col("status") == "succeeded").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(C.pass_rate(F.col("status") == "succeeded", F.col("status").isin("succeeded", "failed")), 6).alias("rate"),
    )


def suite_verdict(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "index_runs", "repo", "status")
    return runs.groupBy("repo").agg(C.verdict(F.col("status") == "aborted", F.col("status") == "failed").alias("verdict"))


def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """A keyword as a prediction of a code language."""
    docs = table(spark, d, "documents", "text", "lang")
    said, true = F.coalesce(F.col("text").contains("function "), F.lit(False)), F.coalesce(F.col("lang").isin("typescript", "javascript"), F.lit(False))
    tp, fp, fn = F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)
    return docs.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(tp / F.nullif(tp + fp, F.lit(0)), 6).alias("precision"), F.round(tp / F.nullif(tp + fn, F.lit(0)), 6).alias("recall"))


def docs_preservation(spark: SparkSession, d: str) -> DataFrame:
    """Required phrases that no document of a repository holds."""
    need = ("retry", "snapshot", "no such phrase")
    docs = table(spark, d, "documents", "repo", "text").filter(F.col("repo").isNotNull() & F.col("text").isNotNull())
    held = docs.select("repo", F.explode(F.array(*[F.when(F.col("text").contains(p), F.lit(p)) for p in need])).alias("phrase")).distinct()
    wanted = docs.select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(p) for p in need])).alias("phrase"))
    return wanted.join(held, ["repo", "phrase"], "left_anti")


def changed_surface(spark: SparkSession, d: str) -> DataFrame:
    """Files named by the caller and files that differ between audits, with where each comes from."""
    from weftline.operators.diff import provenance

    audit = table(spark, d, "audit_files", "path", "status").filter(F.col("path").isNotNull())
    return provenance(audit.filter(F.col("status") == "partial"), audit.filter(F.col("path").startswith("src/")), "path", ("caller", "graph-diff"))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """How fresh each repository's newest audited file is against its last succeeded run."""
    runs = table(spark, d, "index_runs", "repo", "started_at", "status").filter(F.col("status") == "succeeded").groupBy("repo").agg(F.max("started_at").alias("run"))
    files = table(spark, d, "audit_files", "repo", "arrived_at").groupBy("repo").agg(F.max("arrived_at").alias("seen"))
    state = F.when(F.col("run").isNull(), "never-indexed").when(F.col("seen") > F.col("run"), "stale").otherwise("fresh")
    return files.join(runs, "repo", "left").select("repo", state.alias("state"))


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


def largest_files_top10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(10)


def bounded_samples(spark: SparkSession, d: str) -> DataFrame:
    """Up to 20 first files of each language, by path, as one text."""
    rows = table(spark, d, "source_files", "language", "path").filter(F.col("language").isNotNull()).distinct()
    n = F.row_number().over(Window.partitionBy("language").orderBy("path"))
    return rows.withColumn("n", n).filter("n <= 20").groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("sample"))


def audit_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its state: supported, unsupported or unreadable, and the hash of its content."""
    files = table(spark, d, "source_files", "file_no", "path", "content").distinct()
    ext = X.extension(F.col("path"))
    state = F.when(F.col("content").isNull(), "unreadable").when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".py", ".kt", ".java", ".rs"), "supported").otherwise("unsupported")
    return files.select("file_no", state.alias("state"), F.sha2("content", 256).alias("content_sha256"))


def symbol_ids(spark: SparkSession, d: str) -> DataFrame:
    """Qualified ids with encoded parts."""
    n = table(spark, d, "node_snapshots", "path", "symbol_name").filter(F.col("symbol_name").isNotNull()).distinct()
    enc = X.encode_component
    return n.select("path", "symbol_name", F.concat(F.lit("symbolq:"), enc(F.col("path")), F.lit("##"), enc(F.col("symbol_name")), F.lit("#0")).alias("id"))


def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    """An extension: events per hour and type."""
    e = table(spark, d, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions of a user end after 30 minutes without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events", "event_id", "user_id", "ts")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")
    s = e.withColumn("new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    s = s.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def grouping_sets_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """An extension: totals by flag and status, by flag, and over all."""
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


QUERIES = {f.__name__: f for f in (
    candidate_retained_dropped, candidate_adjusted_scores, focus_confidence, near_tie_conflicts, role_boosts,
    evidence_allocation, greedy_packing, interval_merge, interval_merge_in_order, budget_rollup, condition_coverage,
    focus_resolution, selector_cascade, import_resolution, import_name_resolution, alias_resolution,
    api_match_qualification, api_match_candidates, relationship_query, import_target_proof, pass_rates, suite_verdict, precision_recall,
    docs_preservation, changed_surface, freshness, language_counts, largest_files_top10, bounded_samples, audit_ledger,
    symbol_ids, tumbling_events, session_events, grouping_sets_lineitem,
)}

_S = "WITH s AS (SELECT 'part:' || p_partkey AS id, p_size + CASE WHEN starts_with(p_name, 'red') THEN 13 ELSE 0 END AS score FROM part)"
_TEST = r"regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go|rs)$', 'i')"
_DOCS = r"regexp_matches(path, '(^|/)docs?/|\.mdx?$|(^|/)readme[^/]*$', 'i')"


def _boost_sql(role: str) -> str:
    b = C.BOOSTS[role]
    return (
        f"CASE WHEN p_partkey = 7 THEN {b['focus_symbol']} WHEN p_name = 'red widget' THEN {b['focus_file']} ELSE 0 END"
        f" + CASE WHEN p_size = 1 THEN {b['changed_symbol']} WHEN p_size < 4 THEN {b['changed_file']} ELSE 0 END"
        f" + CASE WHEN p_type = 'PROMO' THEN {b['owner_like']} ELSE 0 END + CASE WHEN p_type = 'STANDARD' THEN {b['contract_like']} ELSE 0 END"
        f" + CASE WHEN p_partkey % 3 = 0 THEN {b['adjacent']} ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN {b['exact_query']} ELSE 0 END"
        f" + CASE WHEN p_partkey % 11 = 0 THEN {b['closest_test']} ELSE 0 END AS b_{role.replace('-', '_')}"
    )


SQL = {
    "candidate_retained_dropped": _S + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) <= 50 AS retained FROM s) SELECT id, score, retained, CASE WHEN NOT retained THEN 'over-cap' END AS drop_reason FROM r",
    "focus_confidence": _S + """
, t AS (SELECT id, score, lead(score) OVER (ORDER BY score DESC, id) AS runner_up, row_number() OVER (ORDER BY score DESC, id) AS n FROM s)
SELECT id, score, runner_up, CASE WHEN runner_up IS NULL OR (score - runner_up >= 8 AND (runner_up <= 0 OR (score - runner_up) / runner_up >= 0.25)) THEN 'high'
  WHEN score - runner_up >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM t WHERE n = 1""",
    "near_tie_conflicts": _S + ", b AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 1) SELECT s.id, b.score - s.score AS gap FROM s, b WHERE s.id <> b.id AND abs(b.score - s.score) <= 8",
    "role_boosts": f"SELECT p_partkey, {', '.join(_boost_sql(r) for r in C.BOOSTS)} FROM part",
    "evidence_allocation": """
WITH g AS (SELECT p_type AS grp, count(*) AS have, row_number() OVER (ORDER BY p_type) AS position FROM part GROUP BY p_type),
a AS (SELECT grp, position, least(have, position * 9) AS available, least(have, position * 9, 20, 45) AS base FROM g),
w AS (SELECT *, greatest(0, least(available, 45) - base) AS want FROM a),
p AS (SELECT *, sum(20 - base) OVER () AS pool, coalesce(sum(want) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT grp, CAST(available AS BIGINT) AS available, CAST(base + greatest(0, least(want, pool - before)) AS BIGINT) AS granted FROM p""",
    "interval_merge": """
WITH r AS (SELECT e.file_path AS path, CAST(e.line AS BIGINT) - 5 AS a, CAST(e.line AS BIGINT) + 5 AS b
  FROM (SELECT unnest(evidence_refs) AS e FROM (SELECT DISTINCT edge_no, evidence_refs FROM lineage_edges)) WHERE e.line IS NOT NULL AND e.file_path IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT path, min(a) AS a, max(b) AS b FROM i GROUP BY path, island""",
    "budget_rollup": r"""
WITH l AS (SELECT repo, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS l FROM documents), n AS (SELECT repo, CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS lines FROM l)
SELECT repo, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(max(lines) AS INTEGER) AS longest, CAST(count_if(lines > 160) AS BIGINT) AS truncated FROM n GROUP BY repo""",
    "condition_coverage": f"""
WITH g AS (SELECT repo, bool_or(regexp_matches(string_split(path, '/')[-1], '(command|registry|dispatcher|adapter|analyzer|builder|producer|manager)', 'i')) AS owner,
  bool_or(regexp_matches(string_split(path, '/')[-1], '(types?|schema|valid|constant|error)', 'i')) AS contract, bool_or({_TEST}) AS test FROM source_files GROUP BY repo)
SELECT repo, owner, contract, test, CASE WHEN owner AND contract THEN 'adequate' WHEN owner OR contract THEN 'partial' ELSE 'inadequate' END AS adequacy FROM g""",
    "focus_resolution": """
WITH n AS (SELECT DISTINCT node_id, string_split(label, '.')[-1] AS name FROM node_registry), c AS (SELECT name, count(DISTINCT node_id) AS n, min(node_id) AS one FROM n GROUP BY name)
SELECT name, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS node_id, n AS candidates FROM c
UNION ALL SELECT 'noSuchName', 'not-found', NULL, 0""",
    "selector_cascade": """
WITH k AS (SELECT node_id, CASE WHEN label = 'Mapper' THEN 0 WHEN ends_with(string_split(label, '.')[-1], 'Mapper') THEN 1 WHEN contains(label, 'Mapper') THEN 2 END AS r FROM node_registry)
SELECT node_id, CASE min(r) WHEN 0 THEN 'exact' WHEN 1 THEN 'simple-name' ELSE 'contains' END AS match_kind FROM k WHERE r IS NOT NULL GROUP BY node_id""",
    "import_name_resolution": """
WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS n FROM part),
v AS (SELECT n, coalesce(lead(n) OVER (ORDER BY n), 'cog') AS next FROM (SELECT DISTINCT n FROM w)),
g AS (SELECT a || ' ' || n AS specifier FROM w UNION SELECT a || ' ' || next FROM w JOIN v USING (n)),
c AS (SELECT specifier, count(p_partkey) AS n FROM g LEFT JOIN part ON p_name = specifier GROUP BY specifier)
SELECT specifier, CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, n FROM c""",
    "candidate_adjusted_scores": _RULES.replace("coalesce(content, '')", "''") + r"""
, g AS (SELECT f.file_no, coalesce(string_agg(role, ',') , '') AS roles, bool_or(confidence = 'possible') AS possible FROM f LEFT JOIN res USING (file_no) GROUP BY f.file_no),
u AS (SELECT file_no, CASE WHEN contains(roles, 'generated-file') THEN 'generated-do-not-edit' WHEN contains(roles, 'configuration-file') THEN 'inspect-before-edit'
  WHEN contains(roles, 'internal-planning-docs') THEN 'read-only-reference' WHEN contains(roles, 'public-docs') THEN 'docs-only' WHEN contains(roles, 'test-fixture') THEN 'test-only'
  WHEN roles = '' THEN 'uncertain' WHEN possible THEN 'inspect-before-edit' WHEN regexp_matches(roles, 'command-handler|analyzer|validator') THEN 'safe-primary-edit-target'
  ELSE 'inspect-before-edit' END AS says FROM g),
h AS (SELECT f.file_no, f.path, string_split(f.path, '/')[-1] AS base, CAST(coalesce((length(content) - length(replace(content, 'Router', ''))) // 6, 0) AS INTEGER) AS hits, says FROM f JOIN u USING (file_no)),
k AS (SELECT *, hits + CASE WHEN regexp_matches(base, '^(readme(\.\w+)?|license(\.\w+)?|changelog(\.\w+)?|package\.json|package-lock\.json|tsconfig.*\.json|\.gitignore|\.npmignore)$', 'i') THEN -20 ELSE 0 END AS score FROM h)
SELECT file_no, CAST(score + CASE says WHEN 'safe-primary-edit-target' THEN 6 WHEN 'inspect-before-edit' THEN 3 ELSE 0 END
    + CASE WHEN says = 'docs-only' OR regexp_matches(path, '(^|/)docs?/|\.mdx?$|(^|/)readme[^/]*$', 'i') THEN -4 ELSE 0 END
    + CASE WHEN says = 'test-only' OR regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go|rs)$', 'i') THEN 2 ELSE 0 END AS INTEGER) AS feature_score,
  CAST(score + CASE WHEN regexp_replace(path, '/[^/]*$', '') = 'src' AND contains(path, '/') THEN 4 ELSE 0 END AS INTEGER) AS subsystem_score FROM k""".replace("\\\\", "\\"),
    "greedy_packing": """
WITH RECURSIVE b AS MATERIALIZED (SELECT l_orderkey, l_partkey, CAST(max(l_quantity) AS BIGINT) AS lines, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i
  FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey, l_partkey),
r AS (SELECT l_orderkey, l_partkey, lines, i, lines <= 100 AS included, CASE WHEN lines <= 100 THEN lines ELSE 0 END AS used, CASE WHEN lines <= 100 THEN 1 ELSE 0 END AS n FROM b WHERE i = 1
  UNION ALL SELECT b.l_orderkey, b.l_partkey, b.lines, b.i, r.used + b.lines <= 100 AND r.n < 5,
    r.used + CASE WHEN r.used + b.lines <= 100 AND r.n < 5 THEN b.lines ELSE 0 END, r.n + CASE WHEN r.used + b.lines <= 100 AND r.n < 5 THEN 1 ELSE 0 END
  FROM r JOIN b ON b.l_orderkey = r.l_orderkey AND b.i = r.i + 1)
SELECT l_orderkey, l_partkey, lines, included FROM r""",
    "interval_merge_in_order": """
WITH RECURSIVE e AS (SELECT DISTINCT edge_no, evidence_refs FROM lineage_edges), x AS (SELECT edge_no, unnest(evidence_refs) AS v FROM e),
b AS MATERIALIZED (SELECT v.file_path AS path, CAST(v.line AS BIGINT) - 5 AS a, CAST(v.line AS BIGINT) + 5 AS z, row_number() OVER (PARTITION BY v.file_path ORDER BY edge_no, v.line) AS i
  FROM x WHERE v.line IS NOT NULL AND v.file_path IS NOT NULL),
r AS (SELECT path, i, [{'a': a, 'z': z}] AS kept FROM b WHERE i = 1
  UNION ALL SELECT r.path, b.i, CASE WHEN len(list_filter(r.kept, lambda k: b.a <= k.z AND b.z >= k.a)) = 0 THEN list_append(r.kept, {'a': b.a, 'z': b.z})
    ELSE list_transform(r.kept, lambda k, n: CASE WHEN n = list_position(list_transform(r.kept, lambda m: b.a <= m.z AND b.z >= m.a), true) THEN {'a': least(k.a, b.a), 'z': greatest(k.z, b.z)} ELSE k END) END
  FROM r JOIN b ON b.path = r.path AND b.i = r.i + 1),
f AS (SELECT path, unnest(arg_max(kept, i)) AS k FROM r GROUP BY path)
SELECT path, k.a AS a, k.z AS b FROM f""",
    "alias_resolution": """
SELECT DISTINCT '@part/' || p_name AS specifier, CASE WHEN p_name = 'red ring' THEN 'lib/red-ring' WHEN starts_with(p_name, 'small') THEN 'lib/small/' || substr(p_name, 6) ELSE 'lib/part/' || p_name END AS target FROM part
UNION ALL SELECT DISTINCT p_brand, 'any/' || p_brand FROM part""",
    "api_match_candidates": """
WITH e AS (SELECT DISTINCT 'customer:' || c_custkey AS endpoint, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 3 ELSE c_custkey END AS k FROM customer WHERE c_nationkey < 12),
p AS (SELECT DISTINCT event_id AS call, endpoint FROM events JOIN e ON e.k = user_id * 3) SELECT call, endpoint, count(*) OVER (PARTITION BY call) AS n FROM p""",
    "api_match_qualification": """
WITH e AS (SELECT DISTINCT 'customer:' || c_custkey AS endpoint, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 3 ELSE c_custkey END AS k FROM customer WHERE c_nationkey < 12),
p AS (SELECT event_id AS call, count(DISTINCT endpoint) AS n, min(endpoint) AS one, string_agg(endpoint, '|' ORDER BY endpoint) AS c FROM events LEFT JOIN e ON e.k = user_id * 3 GROUP BY event_id)
SELECT call, CASE n WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS qualification, CASE WHEN n = 1 THEN one END AS target, n, CASE WHEN n > 1 THEN c END AS candidates FROM p""",
    "relationship_query": """
WITH h AS (SELECT DISTINCT edge_no, kind, confidence FROM lineage_edges WHERE kind = 'relates-to' AND confidence = 'explicit')
SELECT edge_no, kind, confidence, (SELECT count(*) FROM h) AS total, (SELECT count(*) <= 64 FROM h) AS complete FROM h ORDER BY edge_no LIMIT 64""",
    "import_target_proof": """
SELECT path, CASE WHEN path IN (SELECT path FROM source_files WHERE path IS NOT NULL) THEN 'present'
  WHEN contains(path, chr(92)) OR starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN 'indeterminate'
  WHEN NOT regexp_matches(path, '^(src|lib|packages)/') THEN 'outside-selected-roots' ELSE 'proven-missing' END AS verdict
FROM (SELECT DISTINCT path FROM audit_files WHERE path IS NOT NULL)""",
    "pass_rates": "SELECT repo, CAST(count_if(status = 'succeeded') AS BIGINT) AS passed, CAST(count_if(status = 'failed') AS BIGINT) AS failed, round(count_if(status = 'succeeded') / nullif(count_if(status IN ('succeeded', 'failed')), 0), 6) AS rate FROM index_runs GROUP BY repo",
    "suite_verdict": "SELECT repo, CASE WHEN bool_or(status = 'aborted') THEN 'BLOCKED' WHEN bool_or(status = 'failed') THEN 'REGRESSION' ELSE 'PASS' END AS verdict FROM index_runs GROUP BY repo",
    "precision_recall": """
WITH x AS (SELECT coalesce(contains(text, 'function '), false) AS said, coalesce(lang IN ('typescript', 'javascript'), false) AS t FROM documents),
c AS (SELECT CAST(count_if(said AND t) AS BIGINT) AS tp, CAST(count_if(said AND NOT t) AS BIGINT) AS fp, CAST(count_if(NOT said AND t) AS BIGINT) AS fn FROM x)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "docs_preservation": """
WITH r AS (SELECT DISTINCT repo FROM documents WHERE repo IS NOT NULL AND text IS NOT NULL), p(phrase) AS (VALUES ('retry'), ('snapshot'), ('no such phrase'))
SELECT repo, phrase FROM r, p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.repo = r.repo AND contains(d.text, p.phrase))""",
    "changed_surface": """
WITH a AS (SELECT DISTINCT path FROM audit_files WHERE status = 'partial' AND path IS NOT NULL), b AS (SELECT DISTINCT path FROM audit_files WHERE starts_with(path, 'src/'))
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'caller' WHEN a.path IS NULL THEN 'graph-diff' ELSE 'both' END AS origin FROM a FULL OUTER JOIN b ON a.path = b.path""",
    "freshness": """
WITH r AS (SELECT repo, max(started_at) AS run FROM index_runs WHERE status = 'succeeded' GROUP BY repo), f AS (SELECT repo, max(arrived_at) AS seen FROM audit_files GROUP BY repo)
SELECT f.repo, CASE WHEN run IS NULL THEN 'never-indexed' WHEN seen > run THEN 'stale' ELSE 'fresh' END AS state FROM f LEFT JOIN r ON r.repo = f.repo""",
    "language_counts": "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "largest_files_top10": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10",
    "bounded_samples": """
WITH r AS (SELECT language, path, row_number() OVER (PARTITION BY language ORDER BY path) AS n FROM (SELECT DISTINCT language, path FROM source_files WHERE language IS NOT NULL))
SELECT language, string_agg(path, '|' ORDER BY path) AS sample FROM r WHERE n <= 20 GROUP BY language""",
    "audit_ledger": r"""
SELECT file_no, CASE WHEN content IS NULL THEN 'unreadable' WHEN lower(regexp_extract(string_split(path, '/')[-1], '(\.[^.]+)$', 1)) IN ('.ts', '.tsx', '.js', '.jsx', '.py', '.kt', '.java', '.rs') THEN 'supported' ELSE 'unsupported' END AS state,
  sha256(content) AS content_sha256 FROM (SELECT DISTINCT file_no, path, content FROM source_files)""",
    "symbol_ids": """
WITH n AS (SELECT DISTINCT path, symbol_name FROM node_snapshots WHERE symbol_name IS NOT NULL)
SELECT path, symbol_name, 'symbolq:' || url_encode(path) || '##' || url_encode(symbol_name) || '#0' AS id FROM n""",
    "tumbling_events": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_events": """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY user_id, session""",
    "grouping_sets_lineitem": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
_IMPORTS = r"""
WITH f AS (SELECT DISTINCT repo, path, content FROM source_files WHERE regexp_matches(path, '\.(ts|tsx|js|jsx)$')),
i AS (SELECT DISTINCT repo, path AS importer, unnest(regexp_extract_all(content, '(?:from\s+|require\()["'']([^"'']+)["'']', 1)) AS specifier FROM f),
b AS (SELECT *, CASE WHEN contains(importer, '/') THEN regexp_replace(importer, '/[^/]*$', '') || '/' ELSE '' END || specifier AS raw FROM i WHERE starts_with(specifier, '.')),
s AS (SELECT *, list_filter(string_split(raw, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM b),
n AS (SELECT repo, importer, specifier, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda x: [x])),
    lambda a, x: CASE WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:-2] ELSE list_concat(a, x) END), '/') AS base FROM s),
c AS (SELECT repo, importer, specifier, unnest(range(0, 9)) AS rank, base || unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS path FROM n
  UNION ALL SELECT repo, importer, specifier, 9, regexp_replace(base, '\.js$', '') || '.ts' FROM n WHERE ends_with(specifier, '.js')
  UNION ALL SELECT repo, importer, specifier, 10, regexp_replace(base, '\.js$', '') || '.tsx' FROM n WHERE ends_with(specifier, '.js')
  UNION ALL SELECT repo, importer, specifier, 11, regexp_replace(base, '\.jsx$', '') || '.tsx' FROM n WHERE ends_with(specifier, '.jsx')),
h AS (SELECT repo, importer, specifier, arg_min(path, rank) AS target FROM c WHERE EXISTS (SELECT 1 FROM f WHERE f.repo = c.repo AND f.path = c.path) GROUP BY ALL)
SELECT repo, importer, specifier, CASE WHEN NOT starts_with(specifier, '.') THEN 'external' WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, target
FROM i LEFT JOIN h USING (repo, importer, specifier)"""
SQL["import_resolution"] = _IMPORTS
