"""The property graph of the star schema, and queries over it with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.session import table

# fixed values: edge kinds of this graph that stand for data flow
FLOW = ["contains", "supplied-by"]
ROOT = "supplier:7"


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def one(name, prefix, key, label):
        return table(spark, d, name, *{key, label}).select(_id(prefix, key).alias("id"), F.lit(prefix).alias("kind"), F.col(label).cast("string").alias("label"))

    parts = [
        one("region", "region", "r_regionkey", "r_name"), one("nation", "nation", "n_nationkey", "n_name"),
        one("customer", "customer", "c_custkey", "c_name"), one("supplier", "supplier", "s_suppkey", "s_name"),
        one("part", "part", "p_partkey", "p_name"), one("orders", "order", "o_orderkey", "o_orderkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    def one(df, source, kind, target):
        return df.select(source.alias("source"), F.lit(kind).alias("kind"), target.alias("target"))

    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    parts = [
        one(table(spark, d, "nation", "n_nationkey", "n_regionkey"), _id("nation", "n_nationkey"), "in-region", _id("region", "n_regionkey")),
        one(table(spark, d, "customer", "c_custkey", "c_nationkey"), _id("customer", "c_custkey"), "in-nation", _id("nation", "c_nationkey")),
        one(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), _id("supplier", "s_suppkey"), "in-nation", _id("nation", "s_nationkey")),
        one(table(spark, d, "orders", "o_orderkey", "o_custkey"), _id("order", "o_orderkey"), "placed-by", _id("customer", "o_custkey")),
        one(items.select("l_orderkey", "l_partkey").distinct(), _id("order", "l_orderkey"), "contains", _id("part", "l_partkey")),
        one(items.select("l_partkey", "l_suppkey").distinct(), _id("part", "l_partkey"), "supplied-by", _id("supplier", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", G.edge_id(F.col("source"), F.col("kind"), F.col("target")))


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def _solvent(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer", "c_custkey", "c_acctbal").filter(F.col("c_acctbal") > 0)
    return nodes(spark, d).filter(F.col("kind") != "customer").select("id").unionByName(rich.select(_id("customer", "c_custkey").alias("id")))


def graph_dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.dangling(edges(spark, d), _solvent(spark, d)).select("id")


def graph_faults(spark: SparkSession, d: str) -> DataFrame:
    return G.checked(_solvent(spark, d), edges(spark, d).filter(F.col("kind") == "placed-by"))


def graph_induced(spark: SparkSession, d: str) -> DataFrame:
    return G.induced(edges(spark, d), nodes(spark, d).filter(F.col("kind").isin("nation", "region", "supplier"))).select("id")


def graph_primary_kind(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies of several kinds between one pair: orders and parts by return flag."""
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    dep = F.when(F.col("l_returnflag") == "A", "import").when(F.col("l_returnflag") == "N", "re-export").otherwise("export-all")
    return G.primary_kind(items.select(_id("order", "l_orderkey").alias("source"), _id("part", "l_partkey").alias("target"), dep.alias("dep")))


def ordinal_identity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts").withColumn("path", F.lit("log"))
    return G.ordinals(e, "path", "user_id", "event_type", "ts", "event_id").select("event_id", "ordinal")


def lookup_in_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).filter(F.col("target") == "nation:3").select("id", "source", "kind")


def lookup_out_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).filter(F.col("source") == "order:42").select("id", "target", "kind")


def lookup_neighbors_d2(spark: SparkSession, d: str) -> DataFrame:
    return G.lookup(spark, nodes(spark, d), edges(spark, d), ROOT, 2)["neighbours"]


def slice_d1_out(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(spark, edges(spark, d), _seed(spark, "order:42"), 1, "outgoing")


def slice_d2_both(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(spark, edges(spark, d), _seed(spark, "order:42", "part:5"), 2, "both")


def slice_d3_in(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(spark, edges(spark, d), _seed(spark, "region:1"), 3, "incoming")


def slice_induced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a slice are the induced ones, whatever their direction."""
    e = edges(spark, d)
    return G.induced(e, G.slice_graph(spark, e, _seed(spark, "order:42"), 2, "outgoing")).select("id")


def slice_kind_pass(spark: SparkSession, d: str) -> DataFrame:
    return G.slice_graph(spark, edges(spark, d), _seed(spark, "order:42"), 1, "outgoing", ["supplied-by", "in-nation", "in-region"])


def slice_summary(spark: SparkSession, d: str) -> DataFrame:
    ids = G.slice_graph(spark, edges(spark, d), _seed(spark, ROOT), 2, "both")
    return G.counts_by(nodes(spark, d).join(ids, "id", "left_semi"))


def slice_capped_dataflow(spark: SparkSession, d: str) -> DataFrame:
    return G.data_flow(spark, edges(spark, d), _seed(spark, ROOT), FLOW, 1)


def reachability_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to part through orders: a composed edge, once for each pair."""
    e = edges(spark, d)
    placed, holds = e.filter(F.col("kind") == "placed-by"), e.filter(F.col("kind") == "contains")
    pairs = placed.select("source", F.col("target").alias("customer")).join(holds.select("source", F.col("target").alias("part")), "source")
    return pairs.select("customer", "part").distinct().withColumn("id", G.edge_id(F.col("customer"), F.lit("reaches"), F.col("part")))


def reachability_traverse(spark: SparkSession, d: str) -> DataFrame:
    return G.traversed(spark, edges(spark, d), _seed(spark, "order:42", "order:43"), 2).select("id")


def view_projection(spark: SparkSession, d: str) -> DataFrame:
    return G.view(nodes(spark, d), edges(spark, d), ["nation"])[0].select("id", "kind")


def view_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.view(nodes(spark, d), edges(spark, d), ["nation"])[1].select("id")


def component_tree(spark: SparkSession, d: str) -> DataFrame:
    """Everything an order leads to, to the fixpoint."""
    return G.closure(spark, edges(spark, d), _seed(spark, "order:42"), "outgoing")


def affected_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """Nodes one step from changed ones, both ways, back to their owners: parts of orders of a day."""
    changed = table(spark, d, "orders", "o_orderkey", "o_orderdate").filter(F.col("o_orderdate") == F.lit("1997-05-28").cast("timestamp_ntz"))
    return G.reach(spark, edges(spark, d), changed.select(_id("order", "o_orderkey").alias("id")), 1, "both")


def adjacency_semijoin(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of a set without the set itself."""
    e, seeds = edges(spark, d), nodes(spark, d).filter((F.col("kind") == "supplier")).select("id")
    near = G.neighbours(e, "both").join(seeds.withColumnRenamed("id", "here"), "here", "left_semi").select(F.col("there").alias("id")).distinct()
    return near.join(seeds, "id", "left_anti")


def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the labels of both ends; an end that is no node leaves nulls."""
    n = nodes(spark, d).filter(F.col("kind") != "region").select("id", "label")
    e = edges(spark, d).filter(F.col("kind").isin("in-region", "in-nation"))
    s, t = n.toDF("source", "source_label"), n.toDF("target", "target_label")
    return e.join(s, "source", "left").join(t, "target", "left").select("id", "source_label", "target_label")


def graph_focus_cap(spark: SparkSession, d: str) -> DataFrame:
    return G.capped_with_focus(nodes(spark, d), "supplier:9", 25, ["kind", "id"]).select("id", "kind")


def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).filter(F.col("kind").isin("nation", "region"))
    return G.dot_lines(n, G.induced(edges(spark, d), n), "geo")


QUERIES = {f.__name__: f for f in (
    graph_nodes, graph_edges, graph_dangling_edges, graph_faults, graph_induced, graph_primary_kind, ordinal_identity,
    lookup_in_edges, lookup_out_edges, lookup_neighbors_d2, slice_d1_out, slice_d2_both, slice_d3_in, slice_induced_edges,
    slice_kind_pass, slice_summary, slice_capped_dataflow, reachability_edges, reachability_traverse, view_projection,
    view_edges, component_tree, affected_neighborhood, adjacency_semijoin, edge_endpoints, graph_focus_cap, graph_dot,
)}

_G = """
WITH nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', CAST(o_orderkey AS VARCHAR) FROM orders),
e0 AS (
  SELECT 'nation:' || n_nationkey AS source, 'in-region' AS kind, 'region:' || n_regionkey AS target FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'in-nation', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'in-nation', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed-by', 'customer:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplied-by', 'supplier:' || l_suppkey FROM lineitem),
edges AS MATERIALIZED (SELECT source, kind, target, source || '--' || kind || '-->' || target AS id FROM e0)"""
_STEPS = {
    "outgoing": "SELECT source AS here, target AS there FROM edges", "incoming": "SELECT target AS here, source AS there FROM edges",
    "both": "SELECT source AS here, target AS there FROM edges UNION ALL SELECT target, source FROM edges",
}


def _reach(seeds: str, depth: int, direction: str, name: str = "reached", kinds: list[str] | None = None) -> str:
    """Level by level CTEs; `name` has (id, level)."""
    only = f" WHERE kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    steps = _STEPS[direction].replace("FROM edges", f"FROM edges{only}")
    out = f",\n{name}_s AS MATERIALIZED ({steps}),\n{name}_0 AS MATERIALIZED (SELECT DISTINCT id, 0 AS level FROM ({seeds}))"
    for i in range(1, depth + 1):
        out += (
            f",\n{name}_{i} AS MATERIALIZED (SELECT * FROM {name}_{i - 1} UNION ALL SELECT DISTINCT there, {i} FROM {name}_s"
            f" WHERE here IN (SELECT id FROM {name}_{i - 1} WHERE level = {i - 1}) AND there NOT IN (SELECT id FROM {name}_{i - 1}))"
        )
    return out + f",\n{name} AS (SELECT * FROM {name}_{depth})"


def _ids(*ids: str) -> str:
    return " UNION ALL ".join(f"SELECT '{i}' AS id" for i in ids)


_SOLVENT = ", solvent AS (SELECT id FROM nodes WHERE kind <> 'customer' UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 0)"
SQL = {
    "graph_nodes": _G + " SELECT * FROM nodes",
    "graph_edges": _G + " SELECT * FROM edges",
    "graph_dangling_edges": _G + _SOLVENT + " SELECT id FROM edges WHERE source NOT IN (SELECT id FROM solvent) OR target NOT IN (SELECT id FROM solvent)",
    "graph_faults": _G + _SOLVENT + " SELECT 'dangling-edge' AS fault, id FROM edges WHERE kind = 'placed-by' AND (source NOT IN (SELECT id FROM solvent) OR target NOT IN (SELECT id FROM solvent))"
    " UNION ALL SELECT 'duplicate-node', id FROM solvent GROUP BY id HAVING count(*) > 1",
    "graph_induced": _G + ", k AS (SELECT id FROM nodes WHERE kind IN ('nation', 'region', 'supplier')) SELECT id FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "graph_primary_kind": """
WITH d AS (SELECT DISTINCT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target,
  CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 're-export' ELSE 'export-all' END AS dep FROM lineitem),
r AS (SELECT *, CASE dep WHEN 'import' THEN 0 WHEN 're-export' THEN 1 ELSE 2 END AS rank, CASE dep WHEN 'import' THEN 'imports' ELSE 'depends-on' END AS kind FROM d)
SELECT source, target, kind, source || '--' || kind || '-->' || target || CASE WHEN rank = min(rank) OVER (PARTITION BY source, target) THEN '' ELSE '#' || dep END AS id FROM r""",
    "ordinal_identity": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS ordinal FROM events",
    "lookup_in_edges": _G + " SELECT id, source, kind FROM edges WHERE target = 'nation:3'",
    "lookup_out_edges": _G + " SELECT id, target, kind FROM edges WHERE source = 'order:42'",
    "lookup_neighbors_d2": _G + _reach(_ids(ROOT), 2, "both") + " SELECT id, level FROM reached WHERE level > 0",
    "slice_d1_out": _G + _reach(_ids("order:42"), 1, "outgoing") + " SELECT id, level FROM reached",
    "slice_d2_both": _G + _reach(_ids("order:42", "part:5"), 2, "both") + " SELECT id, level FROM reached",
    "slice_d3_in": _G + _reach(_ids("region:1"), 3, "incoming") + " SELECT id, level FROM reached",
    "slice_induced_edges": _G + _reach(_ids("order:42"), 2, "outgoing") + ", k AS MATERIALIZED (SELECT DISTINCT id FROM reached), o AS MATERIALIZED (SELECT e.* FROM edges e JOIN k ON k.id = e.source) SELECT o.id FROM o JOIN k ON k.id = o.target",
    "slice_kind_pass": _G + _reach(_ids("order:42"), 1, "outgoing") + _reach("SELECT id FROM reached", 3, "outgoing", "kinded", ["supplied-by", "in-nation", "in-region"]) + " SELECT id FROM kinded",
    "slice_summary": _G + _reach(_ids(ROOT), 2, "both") + " SELECT kind, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM reached) GROUP BY kind",
    "slice_capped_dataflow": _G + """
, flow AS (SELECT id AS edge, source AS here, target AS there FROM edges WHERE kind IN ('contains', 'supplied-by')
  UNION ALL SELECT id, target, source FROM edges WHERE kind IN ('contains', 'supplied-by')),
n AS (SELECT there AS id, min(edge) AS edge FROM flow WHERE here = 'supplier:7' AND there <> 'supplier:7' GROUP BY there)
SELECT id, CAST(row_number() OVER (ORDER BY edge, id) AS INTEGER) AS rank FROM n ORDER BY edge, id LIMIT 200""",
    "reachability_edges": """
WITH p AS (SELECT DISTINCT 'customer:' || o_custkey AS customer, 'part:' || l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT customer, part, customer || '--reaches-->' || part AS id FROM p""",
    "reachability_traverse": _G + _reach(_ids("order:42", "order:43"), 1, "both") + ", k AS MATERIALIZED (SELECT DISTINCT id FROM reached), s AS (SELECT e.* FROM edges e JOIN k ON k.id = e.source) SELECT id FROM s UNION ALL SELECT e.id FROM edges e JOIN k ON k.id = e.target WHERE e.source NOT IN (SELECT id FROM k)",
    "view_projection": _G + ", k AS (SELECT id FROM nodes WHERE kind = 'nation'), near AS (SELECT * FROM edges WHERE source IN (SELECT id FROM k) OR target IN (SELECT id FROM k))"
    " SELECT id, kind FROM nodes WHERE id IN (SELECT id FROM k UNION SELECT source FROM near UNION SELECT target FROM near)",
    "view_edges": _G + ", k AS (SELECT id FROM nodes WHERE kind = 'nation') SELECT id FROM edges WHERE source IN (SELECT id FROM k) OR target IN (SELECT id FROM k)",
    "component_tree": _G + _reach(_ids("order:42"), 6, "outgoing") + " SELECT id, level FROM reached",
    "affected_neighborhood": _G + _reach("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-28'", 1, "both") + " SELECT id, level FROM reached",
    "adjacency_semijoin": _G + _reach("SELECT id FROM nodes WHERE kind = 'supplier'", 1, "both") + " SELECT id FROM reached WHERE level = 1",
    "edge_endpoints": _G + ", k AS (SELECT id, label FROM nodes WHERE kind <> 'region') SELECT e.id, s.label AS source_label, t.label AS target_label"
    " FROM edges e LEFT JOIN k s ON s.id = e.source LEFT JOIN k t ON t.id = e.target WHERE e.kind IN ('in-region', 'in-nation')",
    "graph_focus_cap": _G + " SELECT id, kind FROM nodes ORDER BY CASE WHEN id = 'supplier:9' THEN 0 ELSE 1 END, kind, id LIMIT 25",
    "graph_dot": _G + """
, k AS (SELECT * FROM nodes WHERE kind IN ('nation', 'region'))
SELECT 'digraph geo {' AS line UNION ALL SELECT '}'
UNION ALL SELECT '  "' || id || '" [label="' || label || '"];' FROM k
UNION ALL SELECT '  "' || source || '" -> "' || target || '" [label="' || kind || '"];' FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""",
}
