"""Oracle SQL of the general problems, as one relational statement each, apart from the operators' methods."""

_P1_CORE = """
WITH best AS (
  SELECT repo, snapshot_no, max(delivery_no) AS delivery_no FROM snapshot_deliveries
  WHERE status = 'complete' GROUP BY repo, snapshot_no),
ex AS (
  SELECT *, lag(snapshot_no) OVER w AS prev_no, lead(snapshot_no) OVER w AS next_no FROM best
  WINDOW w AS (PARTITION BY repo ORDER BY snapshot_no)),
rows0 AS (
  SELECT s.repo, s.snapshot_no, e.prev_no, e.next_no, s.node_id, s.kind, s.label, s.path, s.symbol_name, s.symbol_kind,
    s.language, CAST(s.line AS VARCHAR) AS line, CAST(s.exported AS VARCHAR) AS exported,
    s.classification_roles AS classification_roles,
    CASE WHEN s.route_metadata IS NULL THEN NULL ELSE
      (SELECT string_agg(json_quote(k) || ':' || CAST(json_extract(s.route_metadata, '$."' || k || '"') AS VARCHAR), ',' ORDER BY k)
       FROM unnest(json_keys(s.route_metadata)) AS u(k)) END AS route_metadata, s.route_metadata AS raw_metadata,
    row_number() OVER (PARTITION BY s.repo, s.snapshot_no, s.node_id ORDER BY s.created_at DESC) AS rn
  FROM node_snapshots s JOIN ex e USING (repo, snapshot_no, delivery_no)),
cur AS (SELECT * FROM rows0 WHERE rn = 1)
"""

P1_FOUND = _P1_CORE + """
, pairs AS (
  SELECT a.repo, a.snapshot_no, a.node_id, unnest([
    CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END, CASE WHEN a.label IS DISTINCT FROM b.label THEN 'label' END,
    CASE WHEN a.path IS DISTINCT FROM b.path THEN 'path' END,
    CASE WHEN a.symbol_name IS DISTINCT FROM b.symbol_name THEN 'symbol_name' END,
    CASE WHEN a.symbol_kind IS DISTINCT FROM b.symbol_kind THEN 'symbol_kind' END,
    CASE WHEN a.language IS DISTINCT FROM b.language THEN 'language' END,
    CASE WHEN a.line IS DISTINCT FROM b.line THEN 'line' END,
    CASE WHEN a.exported IS DISTINCT FROM b.exported THEN 'exported' END,
    CASE WHEN a.classification_roles IS DISTINCT FROM b.classification_roles THEN 'classification_roles' END,
    CASE WHEN a.route_metadata IS DISTINCT FROM b.route_metadata THEN 'route_metadata' END]) AS field_name
  FROM cur a JOIN cur b ON a.repo = b.repo AND a.prev_no = b.snapshot_no AND a.node_id = b.node_id)
SELECT repo, snapshot_no, node_id, 'changed' AS change_kind, field_name FROM pairs WHERE field_name IS NOT NULL
UNION ALL
SELECT a.repo, a.snapshot_no, a.node_id, 'added', '' FROM cur a
WHERE a.prev_no IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM cur b WHERE b.repo = a.repo AND b.snapshot_no = a.prev_no AND b.node_id = a.node_id)
UNION ALL
SELECT a.repo, a.next_no, a.node_id, 'removed', '' FROM cur a
WHERE a.next_no IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM cur b WHERE b.repo = a.repo AND b.snapshot_no = a.next_no AND b.node_id = a.node_id)
"""

P1_CHANGED_NODES = _P1_CORE + """
, pairs AS (SELECT a.repo, a.snapshot_no, a.node_id, unnest([
    CASE WHEN a.kind IS DISTINCT FROM b.kind THEN {'f': 'kind', 'b': b.kind, 'a': a.kind} END,
    CASE WHEN a.label IS DISTINCT FROM b.label THEN {'f': 'label', 'b': b.label, 'a': a.label} END,
    CASE WHEN a.path IS DISTINCT FROM b.path THEN {'f': 'path', 'b': b.path, 'a': a.path} END,
    CASE WHEN a.symbol_name IS DISTINCT FROM b.symbol_name THEN {'f': 'symbol_name', 'b': b.symbol_name, 'a': a.symbol_name} END,
    CASE WHEN a.symbol_kind IS DISTINCT FROM b.symbol_kind THEN {'f': 'symbol_kind', 'b': b.symbol_kind, 'a': a.symbol_kind} END,
    CASE WHEN a.language IS DISTINCT FROM b.language THEN {'f': 'language', 'b': b.language, 'a': a.language} END,
    CASE WHEN a.line IS DISTINCT FROM b.line THEN {'f': 'line', 'b': b.line, 'a': a.line} END,
    CASE WHEN a.exported IS DISTINCT FROM b.exported THEN {'f': 'exported', 'b': b.exported, 'a': a.exported} END,
    CASE WHEN a.classification_roles IS DISTINCT FROM b.classification_roles THEN {'f': 'classification_roles', 'b': CAST(to_json(b.classification_roles) AS VARCHAR), 'a': CAST(to_json(a.classification_roles) AS VARCHAR)} END,
    CASE WHEN a.route_metadata IS DISTINCT FROM b.route_metadata THEN {'f': 'route_metadata', 'b': b.raw_metadata, 'a': a.raw_metadata} END
  ]) AS c FROM cur a JOIN cur b ON a.repo = b.repo AND a.prev_no = b.snapshot_no AND a.node_id = b.node_id)
SELECT repo, snapshot_no, node_id, c.f AS field_name, c.b AS before, c.a AS after FROM pairs WHERE c IS NOT NULL
"""

P1_MEMBERSHIP = _P1_CORE + """
, k AS (SELECT DISTINCT repo, snapshot_no, node_id FROM cur), p AS (SELECT repo, snapshot_no, prev_no FROM ex WHERE prev_no IS NOT NULL)
SELECT p.repo, p.snapshot_no,
  (SELECT count(*) FROM k WHERE k.repo = p.repo AND k.snapshot_no = p.snapshot_no AND k.node_id NOT IN (SELECT node_id FROM k o WHERE o.repo = p.repo AND o.snapshot_no = p.prev_no)) AS added,
  (SELECT count(*) FROM k WHERE k.repo = p.repo AND k.snapshot_no = p.prev_no AND k.node_id NOT IN (SELECT node_id FROM k o WHERE o.repo = p.repo AND o.snapshot_no = p.snapshot_no)) AS removed,
  (SELECT count(*) FROM k WHERE k.repo = p.repo AND k.snapshot_no = p.snapshot_no AND k.node_id IN (SELECT node_id FROM k o WHERE o.repo = p.repo AND o.snapshot_no = p.prev_no)) AS common
FROM p
"""

_P2_CORE = """
WITH refs AS (
  SELECT 'lineage_edges' AS ref_table, edge_no AS ref_no, 'source' AS ref_field, source AS ref_value, observed_at FROM lineage_edges
  UNION SELECT 'lineage_edges', edge_no, 'target', target, observed_at FROM lineage_edges
  UNION SELECT 'api_unresolved', unresolved_no, 'candidate_node_ids', unnest(candidate_node_ids), observed_at FROM api_unresolved),
j AS (
  SELECT r.ref_table, r.ref_no, r.ref_field, r.ref_value, r.observed_at, count(n.node_id) AS n,
    count(CASE WHEN n.recorded_at <= r.observed_at AND (n.deleted_at IS NULL OR n.deleted_at > r.observed_at) THEN 1 END) AS alive,
    count(CASE WHEN n.recorded_at > r.observed_at THEN 1 END) AS later
  FROM refs r LEFT JOIN node_registry n ON n.node_id = r.ref_value
  WHERE r.ref_value IS NOT NULL GROUP BY ALL),
cases AS (
  SELECT DISTINCT ref_table, ref_no, ref_field, ref_value,
    CASE WHEN n = 0 THEN 'missing' WHEN later = n THEN 'late' ELSE 'deleted' END AS reason,
    strftime(observed_at, '%Y-%m') AS period
  FROM j WHERE alive = 0)
"""
P2_FOUND = _P2_CORE + "SELECT * FROM cases"
P2_REPORT = _P2_CORE + """
SELECT ref_table, ref_field, period, reason, count(*) AS n_refs, count(DISTINCT ref_value) AS n_values
FROM cases GROUP BY 1, 2, 3, 4"""

P3_FOUND = """
WITH runs AS (
  SELECT run_no, repo, started_at,
    lag(run_no) OVER (PARTITION BY repo ORDER BY started_at, run_no) AS prev_run FROM index_runs WHERE status = 'succeeded'),
files AS (
  SELECT DISTINCT repo, regexp_replace(replace(path, chr(92), '/'), '^(\\./)+', '') AS path, lower(content_sha256) AS h, arrived_at, arrival_no
  FROM audit_files),
cur AS (
  SELECT r.run_no, r.prev_run, f.path, f.h,
    row_number() OVER (PARTITION BY r.run_no, f.path ORDER BY f.arrived_at DESC, f.arrival_no DESC) AS rn
  FROM runs r JOIN files f ON f.repo = r.repo AND f.arrived_at <= r.started_at)
SELECT a.run_no, a.path, a.h AS content_sha256 FROM cur a
LEFT JOIN cur b ON b.run_no = a.prev_run AND b.path = a.path AND b.rn = 1
WHERE a.rn = 1 AND a.h IS NOT NULL AND (b.h IS NULL OR b.h <> a.h)
"""

_P4_LATEST = """
WITH last AS (
  SELECT report_no, payload FROM (
    SELECT *, row_number() OVER (PARTITION BY report_no ORDER BY received_at DESC) AS rn FROM audit_reports)
  WHERE rn = 1 AND json_valid(payload)),
doc AS (SELECT report_no, CAST(payload AS JSON) AS j FROM last WHERE json_type(payload, '$.files') = 'ARRAY'),
files AS (
  SELECT report_no, i AS file_pos, json_extract(j, '$.files[' || i || ']') AS f
  FROM (SELECT report_no, j, unnest(range(CAST(json_array_length(j, '$.files') AS BIGINT))) AS i FROM doc))
"""
_P4_FACTS = """
, facts AS (
  SELECT report_no, file_pos, i AS item_pos, json_extract(f, '$.facts[' || i || ']') AS x
  FROM (SELECT report_no, file_pos, f, unnest(range(CAST(json_array_length(f, '$.facts') AS BIGINT))) AS i FROM files WHERE json_type(f, '$.facts') = 'ARRAY')
  UNION ALL SELECT report_no, file_pos, 0, json_extract(f, '$.facts') FROM files WHERE json_type(f, '$.facts') = 'OBJECT')
"""
P4_FOUND = _P4_LATEST + _P4_FACTS + """
SELECT 'fact' AS record_kind, report_no AS root_no, CAST(file_pos AS INTEGER) AS file_pos, CAST(item_pos AS INTEGER) AS item_pos,
  json_extract_string(x, '$.span.startLine') AS value
FROM facts WHERE json_extract_string(x, '$.span.startLine') IS NOT NULL
UNION ALL
SELECT 'capability', report_no, CAST(file_pos AS INTEGER), -1,
  CASE WHEN json_type(f, '$.capabilities.declarations') = 'OBJECT' THEN json_extract_string(f, '$.capabilities.declarations.status')
    ELSE json_extract_string(f, '$.capabilities.declarations') END AS v
FROM files WHERE CASE WHEN json_type(f, '$.capabilities.declarations') = 'OBJECT' THEN json_extract_string(f, '$.capabilities.declarations.status')
    ELSE json_extract_string(f, '$.capabilities.declarations') END IS NOT NULL
UNION ALL
SELECT DISTINCT 'envelope', envelope_no, -1, -1, subject.repository.commit FROM evidence_envelopes
WHERE subject.repository.commit IS NOT NULL
"""
P4_FILES = _P4_LATEST + """
SELECT report_no, CAST(file_pos AS INTEGER) AS file_pos, json_extract_string(f, '$.path') AS path, json_extract_string(f, '$.language') AS language,
  json_extract_string(f, '$.role') AS role, json_extract_string(f, '$.status') AS status,
  json_extract_string(f, '$.contentSha256') AS content_sha256 FROM files
"""
P4_FACTS = _P4_LATEST + _P4_FACTS + """
SELECT report_no, CAST(file_pos AS INTEGER) AS file_pos, CAST(item_pos AS INTEGER) AS fact_pos, json_extract_string(x, '$.kind') AS kind,
  json_extract_string(x, '$.span.startLine') AS start_line FROM facts
"""
P4_CAPABILITIES = _P4_LATEST + """
, caps AS (SELECT report_no, file_pos, k, json_extract(f, '$.capabilities."' || k || '"') AS c
  FROM (SELECT report_no, file_pos, f, unnest(json_keys(f, '$.capabilities')) AS k FROM files WHERE json_type(f, '$.capabilities') = 'OBJECT'))
SELECT report_no, CAST(file_pos AS INTEGER) AS file_pos, k AS capability,
  CASE WHEN json_type(c) = 'OBJECT' THEN json_extract_string(c, '$.status') WHEN json_type(c) = 'VARCHAR' THEN json_extract_string(c, '$') END AS status
FROM caps
"""
P4_SUBJECTS = """
WITH flat AS (
  SELECT DISTINCT envelope_no, evidence_id, subject.authority AS authority, subject.namespace AS namespace, subject.value AS subject_value,
    subject.repository.owner AS owner, subject.repository.name AS name, subject.repository.commit AS commit, received_at
  FROM evidence_envelopes)
SELECT f.envelope_no, evidence_id, authority, namespace, subject_value, owner, name, commit
FROM flat f JOIN (SELECT envelope_no, max(received_at) AS m FROM flat WHERE commit IS NOT NULL GROUP BY envelope_no) l
  ON l.envelope_no = f.envelope_no AND l.m = f.received_at WHERE commit IS NOT NULL
"""

SQL = {
    "p1_found": P1_FOUND, "p1_changed_nodes": P1_CHANGED_NODES, "p1_membership": P1_MEMBERSHIP, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p3_found": P3_FOUND, "p4_found": P4_FOUND,
    "p4_files": P4_FILES, "p4_capabilities": P4_CAPABILITIES, "p4_facts": P4_FACTS, "p4_subjects": P4_SUBJECTS,
}
