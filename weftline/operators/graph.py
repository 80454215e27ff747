"""Property graphs as two tables: building, lookup, bounded slices, reachability, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import materialize

MOST_DEPTH = 3
DATA_FLOW_CAP = 200


def edge_id(source: Column, kind: Column, target: Column, call_line: Column | None = None) -> Column:
    """`<source>--<kind>--><target>`; calls end with `@<line>`."""
    base = F.concat(source, F.lit("--"), kind, F.lit("-->"), target)
    return base if call_line is None else F.when(kind == "calls", F.concat(base, F.lit("@"), call_line)).otherwise(base)


def primary_kind(deps: DataFrame) -> DataFrame:
    """(source, target, kind, id) of file dependencies: the best kind of a pair has the bare id, others end with #kind.

    Rank: import, re-export, export-all; repeated rows are one. `import` gives kind imports, the others depends-on.
    """
    rank = F.when(F.col("dep") == "import", 0).when(F.col("dep") == "re-export", 1).otherwise(2)
    w = Window.partitionBy("source", "target")
    rows = deps.select("source", "target", "dep").distinct().withColumn("rank", rank)
    kind = F.when(F.col("dep") == "import", "imports").otherwise("depends-on")
    bare = edge_id(F.col("source"), kind, F.col("target"))
    named = F.when(F.col("rank") == F.min("rank").over(w), bare).otherwise(F.concat(bare, F.lit("#"), F.col("dep")))
    return rows.select("source", "target", kind.alias("kind"), named.alias("id"))


def ordinals(df: DataFrame, path: str, owner: str, name: str, line: str, index: str) -> DataFrame:
    """Adds ordinal: the rank from 0 among declarations of one (path, owner, name) by line, then extraction index."""
    w = Window.partitionBy(path, owner, name).orderBy(line, index)
    return df.withColumn("ordinal", F.row_number().over(w) - 1)


def checked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Faults of a graph: (fault, id) for repeated node ids, and edges with an end that is no node."""
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate-node").alias("fault"), "id")
    return twice.unionByName(dangling(edges, nodes).select(F.lit("dangling-edge").alias("fault"), "id"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source or target is no node."""
    ids = nodes.select("id").distinct()
    ends = edges.select("id", F.explode(F.array(F.col("source"), F.col("target"))).alias("end"))
    missing = ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti").select("id").distinct()
    return edges.join(missing, "id", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    half = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return half.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there): steps along the edges in a direction: outgoing, incoming or both."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"))
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError(direction)


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(id, level): nodes within `depth` steps of the seeds, with the least number of steps.

    Level by level: the frontier joins the steps, is made distinct before it meets the visited set, and is written to
    the shared folder, so no level is computed twice and the plan does not grow. Ids that are null are not followed.
    """
    steps = neighbours(edges, direction)
    if depth > 1:  # a composed edge table is made once, not at each level
        steps = materialize(spark, steps, "steps")
    frontier = seeds.select("id").filter(F.col("id").isNotNull()).distinct()
    visited = frontier.withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        nxt = steps.join(frontier.withColumnRenamed("id", "here"), "here", "left_semi").select(F.col("there").alias("id"))
        fresh = nxt.filter(F.col("id").isNotNull()).distinct().join(visited.select("id"), "id", "left_anti")
        frontier = materialize(spark, fresh, f"level{level}")
        visited = visited.unionByName(frontier.withColumn("level", F.lit(level)))
    return visited


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(id, level): all nodes the seeds reach, level by level until nothing new appears.

    Every level adds nodes that were not visited, so it ends in a cycle too, at any depth. The visited nodes are written
    anew every few levels, so the plan does not grow with the depth.
    """
    steps = materialize(spark, neighbours(edges, direction), "steps")
    frontier = seeds.select("id").filter(F.col("id").isNotNull()).distinct()
    visited = frontier.withColumn("level", F.lit(0))
    level = 0
    while True:
        level += 1
        nxt = steps.join(frontier.withColumnRenamed("id", "here"), "here", "left_semi").select(F.col("there").alias("id"))
        nxt = nxt.filter(F.col("id").isNotNull())
        frontier = materialize(spark, nxt.distinct().join(visited.select("id"), "id", "left_anti"), f"closure{level}")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier.withColumn("level", F.lit(level)))
        if level % 16 == 0:
            visited = materialize(spark, visited, f"visited{level}")


def lookup(spark: SparkSession, nodes: DataFrame, edges: DataFrame, node: str, depth: int) -> dict[str, DataFrame]:
    """A node with its incident edges and its neighbours up to `depth` (0 to 3; 0 gives none).

    `found` has the node rows: none is not found, more than one is ambiguous.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError("depth must be 0 to 3")
    seed = nodes.filter(F.col("id") == node).select("id").distinct()
    near = reach(spark, edges, seed, depth).filter(F.col("level") > 0)
    return {
        "found": nodes.filter(F.col("id") == node),
        "incoming": edges.filter(F.col("target") == node),
        "outgoing": edges.filter(F.col("source") == node),
        "neighbours": near,
    }


def slice_graph(
    spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", kinds: list[str] | None = None
) -> DataFrame:
    """Ids of a slice: nodes within `depth`, then, with kinds, what edges of those kinds reach from all of them.

    The pass over kinds goes max(3, depth) steps in the same direction.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError("depth must be 0 to 3")
    got = reach(spark, edges, seeds, depth, direction).select("id")
    if kinds:
        got = reach(spark, edges.filter(F.col("kind").isin(kinds)), got, max(3, depth), direction).select("id")
    return got


def data_flow(spark: SparkSession, edges: DataFrame, included: DataFrame, kinds: list[str], depth: int, cap: int = DATA_FLOW_CAP) -> DataFrame:
    """(id, rank): nodes that edges of the kinds add in both directions, at most `cap`, in order of (level, parent, edge).

    The parent order of level 1 is the id, later that of the level before, the edge order is the id: a bounded search in
    breadth with a fixed order. Each level keeps at most `cap` rows, so a later one joins a bounded frontier.
    """
    flow = edges.filter(F.col("kind").isin(kinds)).select("id", "source", "target")
    both = flow.select("id", F.col("source").alias("here"), F.col("target").alias("there")).unionByName(
        flow.select("id", F.col("target").alias("here"), F.col("source").alias("there"))
    )
    base = included.select("id").distinct()
    frontier = base.select("id", F.col("id").alias("order"))
    taken = None
    for level in range(1, depth + 1):
        step = both.withColumnRenamed("id", "edge").join(frontier.withColumnRenamed("id", "here"), "here")
        key = F.struct("order", "edge")
        fresh = step.filter(F.col("there").isNotNull()).groupBy(F.col("there").alias("id")).agg(F.min(key).alias("key")).join(base, "id", "left_anti")
        if taken is not None:
            fresh = fresh.join(taken.select("id"), "id", "left_anti")
        top = fresh.orderBy("key", "id").limit(cap)
        rank = F.row_number().over(Window.orderBy("key", "id"))  # at most cap rows
        new = top.select("id", F.format_string("%03d:%06d", F.lit(level), rank).alias("order"))
        new = materialize(spark, new, f"flow{level}")
        taken = new if taken is None else taken.unionByName(new)
        frontier = new
    if taken is None:
        return base.limit(0).withColumn("rank", F.lit(0))
    return taken.orderBy("order").limit(cap).select("id", F.row_number().over(Window.orderBy("order")).alias("rank"))


def traversed(spark: SparkSession, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Edges met on the way from the roots, both directions: those at a frontier of level 0 to depth - 1, not the induced ones."""
    inner = reach(spark, edges, roots, depth - 1).select("id") if depth else roots.select("id").limit(0)
    here = edges.join(inner.withColumnRenamed("id", "source"), "source", "left_semi")
    there = edges.join(inner.withColumnRenamed("id", "target"), "target", "left_semi")
    return here.unionByName(there.select(here.columns)).distinct()


def counts_by(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def view(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds with everything one edge away, and the edges that touch a node of the kinds."""
    seed = nodes.filter(F.col("kind").isin(kinds)).select("id")
    near = edges.join(seed.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(
        edges.join(seed.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)
    ).distinct()
    ids = seed.unionByName(near.select(F.col("source").alias("id"))).unionByName(near.select(F.col("target").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi"), near


def capped_with_focus(nodes: DataFrame, focus: str, cap: int, order: list[str]) -> DataFrame:
    """At most `cap` nodes; the focus is always kept, in place of the last."""
    first = F.when(F.col("id") == focus, 0).otherwise(1)
    return nodes.orderBy(first, *order).limit(cap)


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "graph") -> DataFrame:
    """(n, line): the graph as DOT text, one line a row, in order."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"),
                     F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2), F.col("source"), F.col("id"),
                     F.concat(F.lit("  "), quote(F.col("source")), F.lit(" -> "), quote(F.col("target")), F.lit(" [label="), quote(F.col("kind")), F.lit("];")))
    head = nodes.sparkSession.createDataFrame([(0, "", "", f"digraph {name} {{"), (3, "", "", "}")], n.schema)
    return head.union(n).union(e).orderBy("part", "a", "b", "line").select("line")


def enrich(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the nodes and edges of another source appended: of one id the graph's own row holds.

    Columns that one side lacks are null there. Edges to nodes that neither side has are kept: see dangling().
    """
    a = more_nodes.join(nodes.select("id"), "id", "left_anti").dropDuplicates(["id"])
    b = more_edges.join(edges.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return nodes.unionByName(a, allowMissingColumns=True), edges.unionByName(b, allowMissingColumns=True)
