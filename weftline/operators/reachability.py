"""How users reach code: routes, storage keys, interface texts, tests, and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import lines
from weftline.operators import graph
from weftline.operators.rules import REACH_LEVELS, level

# fixed values: how far a slice goes from each kind of root, and the lines shown round a fact
DEPTHS = {"route": 1, "storage": 2, "ui": 2}
AROUND = 10


def fact_id(kind: Column, marker: Column, value: Column) -> Column:
    """route:<lower>, storage:<kind>:<key>, ui:<marker>:<lower, white space as ->, at most 64 characters>."""
    text = F.substring(F.regexp_replace(F.lower(F.trim(value)), r"\s+", "-"), 1, 64)
    return F.when(kind == "route", F.concat(F.lit("route:"), F.lower(value))).when(kind == "storage", F.concat(F.lit("storage:"), marker, F.lit(":"), value)).otherwise(F.concat(F.lit("ui:"), marker, F.lit(":"), text))


def reach_facts(facts: DataFrame) -> DataFrame:
    """(id, kind, value, marker, confidence, files) of extracted facts, merged by id.

    Of several observations the lower confidence holds: a computed route or key is low, a static one high, a text of an
    element medium. Files are the sorted paths that show the fact. Facts without a value are left out.
    """
    kind = F.when(F.col("record") == "route", "route").when(F.col("record") == "storage", "storage").when(F.col("record").isin("ui_string", "locator", "test"), "ui")
    marker = F.when(F.col("record") == "storage", F.col("kind")).when(F.col("record") == "ui_string", "text").when(F.col("record") == "locator", F.col("kind")).otherwise(F.col("record"))
    sure = F.when(F.col("name").rlike(r"[:*{$]"), "low").when(F.col("record") == "ui_string", "medium").otherwise("high")
    rows = facts.withColumn("_k", kind).filter(F.col("_k").isNotNull() & (F.trim("name") != ""))
    one = rows.select(fact_id(F.col("_k"), marker, F.col("name")).alias("id"), F.col("_k").alias("kind"), F.col("name").alias("value"), marker.alias("marker"), sure.alias("confidence"), "path")
    names = F.array(*[F.lit(x) for x in REACH_LEVELS])
    return one.groupBy("id").agg(
        F.first("kind").alias("kind"), F.min("value").alias("value"), F.first("marker").alias("marker"),
        F.element_at(names, F.min(level(F.col("confidence"), REACH_LEVELS))).alias("confidence"), F.array_sort(F.collect_set("path")).alias("files"),
    )


def reach_edges(facts: DataFrame, components: DataFrame) -> DataFrame:
    """(id, source, target, kind): route to component, component to text, storage key to text, test to text.

    `components` has component and path: where it is declared. Facts belong to the component of their file, so edges are
    equi-joins on paths; a test reaches the texts its locators name, whatever the file.
    """
    where = facts.select("id", "kind", "value", "marker", F.explode("files").alias("path"))
    comp = components.select(F.concat(F.lit("component:"), "component").alias("component"), "path").distinct()

    def edge(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
        return df.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind")).distinct()

    routes, stores = where.filter("kind = 'route'"), where.filter("kind = 'storage'")
    texts = where.filter("kind = 'ui' and marker = 'text'")
    locators = where.filter("kind = 'ui' and marker not in ('text', 'test', 'it', 'describe')")
    tests = where.filter("kind = 'ui' and marker = 'test'")
    ui = texts.select("path", F.col("id").alias("ui"))
    out = edge(routes.join(comp, "path"), "id", "component", "route-renders-component")
    out = out.unionByName(edge(comp.join(ui, "path"), "component", "ui", "component-shows-ui"))
    out = out.unionByName(edge(stores.join(ui, "path"), "id", "ui", "storage-gates-ui"))
    named = locators.select("path", "value").join(texts.select("value", F.col("id").alias("ui")), "value")
    out = out.unionByName(edge(tests.select("path", "id").join(named, "path"), "id", "ui", "test-covers-ui"))
    return out.withColumn("id", graph.edge_id(F.col("source"), F.col("kind"), F.col("target")))


def find(facts: DataFrame, kind: str, query: str, exact: bool = False) -> DataFrame:
    """Facts of a kind by id or value: equal, or with the query inside."""
    hit = (F.col("id") == query) | (F.col("value") == query) if exact else F.lower("value").contains(query.lower()) | (F.col("id") == query)
    return facts.filter((F.col("kind") == kind) & hit)


def related(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a seed."""
    s = seeds.select("id")
    return edges.join(s.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(s.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)).distinct()


def reach_slice(spark: SparkSession, edges: DataFrame, roots: DataFrame, kind: str) -> DataFrame:
    """The edges met from the roots, as far as their kind goes."""
    return graph.traversed(spark, edges, roots.select("id"), DEPTHS[kind])


def reach_source(found: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, line, from_line, to_line, slice): AROUND lines round each place of facts (id, path, line)."""
    got = found.join(files.select("path", lines(F.col("content")).alias("_l")), "path")
    lo, hi = F.greatest(F.lit(1), F.col("line") - AROUND), F.least(F.size("_l"), F.col("line") + AROUND)
    return got.withColumns({"from_line": lo, "to_line": hi}).select("id", "path", "line", "from_line", "to_line", F.array_join(F.slice("_l", F.col("from_line"), F.col("to_line") - F.col("from_line") + 1), "\n").alias("slice"))


def react_region(facts: DataFrame, name: str) -> DataFrame:
    """The one region a name means: component, then handler, hook, text; an exact name before one that differs in case."""
    order = F.when(F.col("record") == "symbol", 0).when(F.col("record") == "component", 1).when(F.col("record") == "handler", 2).when(F.col("record") == "hook", 3).when(F.col("record") == "ui_string", 4)
    hit = facts.withColumn("_o", order).filter(F.col("_o").isNotNull() & (F.lower("name") == name.lower()))
    exact = F.when(F.col("name") == name, 0).otherwise(1)
    return hit.orderBy(exact, "_o", "path", "line").limit(1).drop("_o")


def test_infrastructure(facts: DataFrame, is_test: Column) -> DataFrame:
    """(specifier, files): what test files import, most used first: runners, helpers, mocks and fixtures."""
    rows = facts.filter((F.col("record") == "import") & is_test)
    return rows.groupBy(F.col("name").alias("specifier")).agg(F.count_distinct("path").alias("files"))
