"""Search, literal scans and source slices over the given tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import exact_scan as E
from weftline.operators import text_search as S
from weftline.session import table

PART_QUERY = "red widget brand"
DOC_QUERY = "stable register queue"
NEEDLE = "retry"


def _part_fields(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    key = F.concat(F.lit("part:"), F.col("p_partkey"))
    return S.fields(part, "part", key, {"symbolName": F.col("p_name"), "label": F.col("p_type"), "symbolKind": F.col("p_brand")})


def _top(df: DataFrame, n: int) -> DataFrame:
    return S.ranked(df, n).select("kind", "id", "score", "matched_terms")


def search_relevance_part(spark: SparkSession, d: str) -> DataFrame:
    return _top(S.relevance(_part_fields(spark, d), PART_QUERY), 100)


def search_repeated_terms(spark: SparkSession, d: str) -> DataFrame:
    """A repeated term never earns the bonus."""
    return _top(S.relevance(_part_fields(spark, d), "red red"), 100)


def _doc_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source", "path")
    key = F.concat(F.lit("doc:"), F.col("doc_id"))
    cells = {"path": F.col("path"), "label": F.col("text"), "symbolKind": F.col("lang"), "semanticRole": F.col("source")}
    return S.fields(docs, "file", key, cells, F.col("path"))


def search_relevance_documents(spark: SparkSession, d: str) -> DataFrame:
    return _top(S.relevance(_doc_fields(spark, d), DOC_QUERY), 100)


def search_all_scores_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with a match, unranked: the scorer without its limit."""
    return S.relevance(_doc_fields(spark, d), DOC_QUERY).select("id", "score", "matched_terms")


def search_exact_id(spark: SparkSession, d: str) -> DataFrame:
    return _top(S.relevance(S.scoped(_part_fields(spark, d), "part:7"), "red widget"), 20)


def search_reasons_part(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of the best candidates in their order."""
    top = S.ranked(S.relevance(_part_fields(spark, d), PART_QUERY), 20)
    one = top.select("id", F.posexplode(S.reason_order(F.col("reasons"))).alias("n", "r"))
    return one.select("id", "n", (-F.col("r.w")).alias("weight"), "r.field", "r.term", "r.text")


def search_name_ceiling(spark: SparkSession, d: str) -> DataFrame:
    scored = S.relevance(_part_fields(spark, d), "small ring")
    exact = F.exists("reasons", lambda r: (r["field"] == "symbolName") & (F.lower(r["text"]) == "small ring"))
    return S.ceiling(scored, exact).select("id", "score")


def search_owner_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers behind the best parts."""
    seeds = S.relevance(_part_fields(spark, d), PART_QUERY).select("id", "score")
    items = table(spark, d, "lineitem", "l_partkey", "l_suppkey")
    deps = items.select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("target"))
    return S.recover_owners(seeds, deps).select("target", "seed_count", "best_seed_score")


def search_ownership_tiers(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files", "file_no", "path", "role").distinct()
    test = X.is_test_path(F.col("path")) | X.is_fixture_path(F.col("path")) | X.is_generated_path(F.col("path")) | X.is_docs_path(F.col("path"))
    eligible = F.col("path").isNotNull() & ~test
    owner = F.lower(X.basename(F.col("path"))).contains("router")
    return files.select("file_no", S.tiers(files, eligible, owner).alias("tier"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def exact_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return E.matches(_docs(spark, d), "doc_id", "text", NEEDLE).select("doc_id", "line", "column")


def exact_scan_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """A needle that can overlap itself."""
    return E.matches(_docs(spark, d), "doc_id", "text", "--").select("doc_id", "line", "column")


def exact_scan_capped(spark: SparkSession, d: str) -> DataFrame:
    return E.capped(E.matches(_docs(spark, d), "doc_id", "text", NEEDLE), "doc_id").select("doc_id", "line", "column", "total", "truncated")


def match_context_window(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    found = E.matches(docs, "doc_id", "text", NEEDLE)
    return E.window_around(found, docs, "doc_id", "text", 1, 2).select("doc_id", "line", "column", "from_line", "to_line", "context")


def classify_match_cascade(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files", "file_no", "content").distinct()
    found = E.matches(files, "file_no", "content", "Router")
    return found.select("file_no", "line", "column", E.match_kind(F.col("line_text"), F.col("column")).alias("match_kind"))


def line_slice(spark: SparkSession, d: str) -> DataFrame:
    return E.line_slice(_docs(spark, d), "doc_id", "text", 3, 5)


def continuation_cursor(spark: SparkSession, d: str) -> DataFrame:
    got = E.line_slice(_docs(spark, d), "doc_id", "text", 3, 5)
    known = F.when(F.col("doc_id") % 3 == 0, F.lit(6)).when(F.col("doc_id") % 3 == 1, F.lit(12))
    nxt, reason = E.cursor(F.col("end_line"), F.col("total_lines"), known)
    return got.select("doc_id", nxt.alias("next_line"), reason.alias("reason"))


def occurrence_proof(spark: SparkSession, d: str) -> DataFrame:
    """How often the literal stands in each file, and whether the count is a proof: the file is small enough and hashed."""
    files = table(spark, d, "documents", "doc_id", "text")
    n = F.size(X.literal_pieces(F.col("text"), NEEDLE)) - 1
    complete = F.col("text").isNotNull() & (F.length("text") <= 200_000)
    code = F.when(F.col("text").isNull(), "unreadable").when(~complete, "too-large").otherwise("complete")
    return files.select("doc_id", F.when(F.col("text").isNotNull(), n).alias("occurrences"), complete.alias("complete"),
                        code.alias("reason_code"), F.sha2("text", 256).alias("content_sha256"))


def inventory_page(spark: SparkSession, d: str) -> DataFrame:
    return E.page(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"], 64, 3)


def fact_page(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", "event_id", "event_type", "ts")
    return E.page(events, ["event_type", "ts", "event_id"], 128, 2).select("event_id", "event_type")


def query_tokens_documents(spark: SparkSession, d: str) -> DataFrame:
    """The query tokenizer over the labels of the registry."""
    nodes = table(spark, d, "node_registry", "label").distinct()
    return nodes.select("label", F.array_join(X.tokens(F.col("label")), "|").alias("terms"))


def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "audit_files", "path").filter(p.isNotNull()).distinct().select(
        "path", X.is_test_path(p).alias("is_test"), X.is_docs_path(p).alias("is_docs"), X.is_generated_path(p).alias("is_generated"),
        X.is_fixture_path(p).alias("is_fixture"), X.canonical_path(p).alias("is_canonical"), X.basename(p).alias("base"),
        X.extension(p).alias("ext"),
    )


QUERIES = {f.__name__: f for f in (
    search_relevance_part, search_repeated_terms, search_relevance_documents, search_all_scores_documents, search_exact_id,
    search_reasons_part, search_name_ceiling, search_owner_recovery, search_ownership_tiers, exact_scan_documents,
    exact_scan_overlapping, exact_scan_capped, match_context_window, classify_match_cascade, line_slice,
    continuation_cursor, occurrence_proof, inventory_page, fact_page, query_tokens_documents, path_predicates,
)}


def _terms(rows: list[tuple[str, int, int]]) -> str:
    return ", ".join(f"('{t}', {m}, {i})" for t, m, i in rows)


_PART = """
f AS (SELECT 'part:' || p_partkey AS id, 'symbolName' AS field, p_name AS text, 12 AS w FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'label', p_type, 6 FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'symbolKind', p_brand, 4 FROM part)"""
_DOC = """
f AS (SELECT 'doc:' || doc_id AS id, 'path' AS field, path AS text, 8 AS w FROM documents
  UNION ALL SELECT 'doc:' || doc_id, 'label', text, 6 FROM documents
  UNION ALL SELECT 'doc:' || doc_id, 'symbolKind', lang, 4 FROM documents
  UNION ALL SELECT 'doc:' || doc_id, 'semanticRole', source, 7 FROM documents)"""


def _scored(source: str, query: str, pool: str = "") -> str:
    terms = X.tokenize(query)
    rows = [(query, 2, 0)] + [(t, 1, 1) for t in dict.fromkeys(terms)]
    flat = "trim(regexp_replace(f.text, '\\s+', ' ', 'g'))"
    return f"""WITH {source.strip()},
t(term, mult, is_term) AS (VALUES {_terms(rows)}),
r AS (SELECT DISTINCT f.id, f.field, t.term, t.is_term, f.w * t.mult AS weight,
    CASE WHEN length({flat}) > 120 THEN left({flat}, 117) || '...' ELSE {flat} END AS text
  FROM f JOIN t ON contains(lower(f.text), t.term) {pool}),
s AS (SELECT id, CAST(sum(weight) + CASE WHEN count(DISTINCT CASE WHEN is_term = 1 THEN term END) = {len(terms)} THEN 10 ELSE 0 END AS BIGINT) AS score,
    count(DISTINCT CASE WHEN is_term = 1 THEN term END) AS matched_terms FROM r GROUP BY id)"""


_LINES = r"""
WITH l0 AS (SELECT {key} AS k, regexp_split_to_array({text}, '\r?\n') AS l FROM {source} WHERE {text} IS NOT NULL),
l AS (SELECT k, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM l0),
n AS (SELECT k, l, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS line FROM l),
p AS (SELECT k, l, line, string_split(l[line], '{needle}') AS pieces FROM n WHERE contains(l[line], '{needle}')),
m AS (SELECT k, l, line, pieces, unnest(range(1, CAST(len(pieces) AS BIGINT))) AS j FROM p),
found AS (SELECT k, l, CAST(line AS INTEGER) AS line,
  CAST(list_sum(list_transform(pieces[1:j], lambda x: length(x))) + (j - 1) * {size} + 1 AS INTEGER) AS "column" FROM m)"""


def _lines(needle: str, key: str = "doc_id", text: str = "text", source: str = "documents") -> str:
    return _LINES.format(key=key, text=text, source=source, needle=needle, size=len(needle))


_TEST = r"regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go|rs)$', 'i')"
_FIXTURE = r"regexp_matches(path, '(^|/)(__)?fixtures?(__)?/', 'i')"
_GENERATED = r"regexp_matches(path, '(^|/)generated/|\.(generated|gen)\.[jt]sx?$', 'i')"
_DOCS = r"regexp_matches(path, '(^|/)docs?/|\.mdx?$|(^|/)readme[^/]*$', 'i')"
_SLICE = r"""
WITH l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM l0),
s AS (SELECT doc_id, 3 AS start_line, CAST(least(len(l), 7) AS INTEGER) AS end_line, CAST(len(l) AS INTEGER) AS total_lines,
  CASE WHEN len(l) >= 3 THEN array_to_string(l[3:7], chr(10)) ELSE '' END AS slice FROM l)"""

SQL = {
    "search_relevance_part": _scored(_PART, PART_QUERY) + " SELECT 'part' AS kind, id, score, matched_terms FROM s ORDER BY score DESC, id LIMIT 100",
    "search_repeated_terms": _scored(_PART, "red red") + " SELECT 'part' AS kind, id, score, matched_terms FROM s ORDER BY score DESC, id LIMIT 100",
    "search_relevance_documents": _scored(_DOC, DOC_QUERY)
    + " SELECT 'file' AS kind, id, score, matched_terms FROM s LEFT JOIN (SELECT 'doc:' || doc_id AS id, path FROM documents) USING (id)"
    " ORDER BY score DESC, coalesce(path, id), id LIMIT 100",
    "search_all_scores_documents": _scored(_DOC, DOC_QUERY) + " SELECT id, score, matched_terms FROM s",
    "search_exact_id": _scored(_PART, "red widget", "AND f.id = 'part:7'") + " SELECT 'part' AS kind, id, score, matched_terms FROM s ORDER BY score DESC, id LIMIT 20",
    "search_reasons_part": _scored(_PART, PART_QUERY) + """
, top AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 20)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, field, term, text) - 1 AS INTEGER) AS n, weight, field, term, text
FROM r JOIN top USING (id)""",
    "search_name_ceiling": _scored(_PART, "small ring") + """
, e AS (SELECT s.id, s.score, (SELECT count(*) FROM part WHERE 'part:' || p_partkey = s.id AND p_name = 'small ring') > 0 AS exact FROM s),
c AS (SELECT min(score) AS least FROM e WHERE exact)
SELECT id, CASE WHEN exact OR c.least IS NULL THEN score ELSE least(score, c.least - 1) END AS score FROM e, c""",
    "search_owner_recovery": _scored(_PART, PART_QUERY) + """
, best AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS seed_rank FROM (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20)),
pairs AS (SELECT DISTINCT seed_rank, score, 'supplier:' || l_suppkey AS target FROM lineitem JOIN best ON best.id = 'part:' || l_partkey),
kept AS (SELECT *, row_number() OVER (PARTITION BY seed_rank ORDER BY target) AS n FROM pairs)
SELECT target, count(*) AS seed_count, max(score) AS best_seed_score FROM kept WHERE n <= 16 GROUP BY target ORDER BY min(seed_rank), target LIMIT 128""",
    "search_ownership_tiers": f"""
SELECT file_no, CASE WHEN ok AND contains(lower(string_split(path, '/')[-1]), 'router') THEN 0 WHEN ok THEN 1 ELSE 2 END AS tier
FROM (SELECT DISTINCT file_no, path, role, path IS NOT NULL AND NOT ({_TEST} OR {_FIXTURE} OR {_GENERATED} OR {_DOCS}) AS ok FROM source_files)""",
    "exact_scan_documents": _lines(NEEDLE) + ' SELECT k AS doc_id, line, "column" FROM found',
    "exact_scan_overlapping": _lines("--") + ' SELECT k AS doc_id, line, "column" FROM found',
    "exact_scan_capped": _lines(NEEDLE) + ' SELECT k AS doc_id, line, "column", (SELECT count(*) FROM found) AS total, (SELECT count(*) > 200 FROM found) AS truncated'
    ' FROM found ORDER BY k, line, "column" LIMIT 200',
    "match_context_window": _lines(NEEDLE) + """
SELECT k AS doc_id, line, "column", CAST(greatest(1, line - 1) AS INTEGER) AS from_line, CAST(least(len(l), line + 2) AS INTEGER) AS to_line,
  array_to_string(l[greatest(1, line - 1):least(len(l), line + 2)], chr(10)) AS context FROM found""",
    "classify_match_cascade": _lines("Router", "file_no", "content", "(SELECT DISTINCT file_no, content FROM source_files)") + r"""
, h AS (SELECT k AS file_no, line, "column", rtrim(regexp_replace(rtrim(substr(l[line], 1, "column" - 1), ' '), '["''`]$', ''), ' ') AS head FROM found)
SELECT file_no, line, "column", CASE WHEN regexp_matches(head, '(===|!==|==|!=|<=|>=|<|>)$') THEN 'usage' WHEN regexp_matches(head, '[,(]$') THEN 'usage'
  WHEN regexp_matches(head, '\b(const|let|var|type)\b.*=$') THEN 'declaration' WHEN regexp_matches(head, '\w=$') THEN 'usage'
  WHEN regexp_matches(head, ':$') THEN 'declaration' ELSE 'unknown' END AS match_kind FROM h""",
    "line_slice": _SLICE + " SELECT * FROM s",
    "continuation_cursor": _SLICE + """
, k AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 END AS known FROM s)
SELECT doc_id, CASE WHEN (known IS NOT NULL AND end_line >= known) OR end_line + 1 > total_lines THEN NULL ELSE end_line + 1 END AS next_line,
  CASE WHEN known IS NOT NULL AND end_line >= known THEN NULL WHEN end_line + 1 > total_lines THEN 'eof'
    WHEN known IS NULL THEN 'symbol-end-unknown' ELSE 'window-capped' END AS reason FROM k""",
    "occurrence_proof": f"""
SELECT doc_id, CAST(len(string_split(text, '{NEEDLE}')) - 1 AS INTEGER) AS occurrences, text IS NOT NULL AND length(text) <= 200000 AS complete,
  CASE WHEN text IS NULL THEN 'unreadable' WHEN length(text) > 200000 THEN 'too-large' ELSE 'complete' END AS reason_code, sha256(text) AS content_sha256
FROM documents""",
    "inventory_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 64 OFFSET 192",
    "fact_page": "SELECT event_id, event_type FROM events ORDER BY event_type, ts, event_id LIMIT 128 OFFSET 256",
    "query_tokens_documents": r"""
SELECT label, array_to_string(list_filter(regexp_split_to_array(lower(trim(label)), '[\s.,;:()\[\]{}<>"''`|\\/!?@#$%^&*+=~-]+'), lambda x: x <> ''), '|') AS terms
FROM (SELECT DISTINCT label FROM node_registry)""",
    "path_predicates": f"""
SELECT path, {_TEST} AS is_test, {_DOCS} AS is_docs, {_GENERATED} AS is_generated, {_FIXTURE} AS is_fixture,
  NOT contains(path, chr(92)) AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '^[A-Za-z]:')
    AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS is_canonical,
  string_split(path, '/')[-1] AS base, lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^.]+)$', 1)) AS ext
FROM (SELECT DISTINCT path FROM audit_files WHERE path IS NOT NULL)""",
}
