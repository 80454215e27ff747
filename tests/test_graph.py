import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as G

EDGES = [("a", "x", "b"), ("b", "x", "c"), ("c", "x", "a"), ("c", "y", "d"), ("d", "x", "d"), ("a", "y", "b"), ("d", "x", "gone"), (None, "x", "a")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n, "k", n.upper()) for n in "abcde"], "id string, kind string, label string")
    edges = spark.createDataFrame(EDGES, "source string, kind string, target string").withColumn("id", F.concat_ws("|", "source", "kind", "target"))
    return nodes, edges


def ids(df, *cols):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols or ["id"]).collect())


def seed(spark, *s):
    return spark.createDataFrame([(x,) for x in s], "id string")


def test_reach(spark, graph):
    _, e = graph
    assert ids(G.reach(spark, e, seed(spark, "a"), 2, "outgoing"), "id", "level") == [("a", 0), ("b", 1), ("c", 2)]
    assert ids(G.reach(spark, e, seed(spark, "d"), 1, "incoming"), "id", "level") == [("c", 1), ("d", 0)]
    assert ids(G.reach(spark, e, seed(spark, "d"), 2), "id", "level") == [("a", 2), ("b", 2), ("c", 1), ("d", 0), ("gone", 1)]
    assert ids(G.reach(spark, e, seed(spark, "a"), 0)) == ["a"]
    assert ids(G.reach(spark, e, seed(spark), 2)) == []
    assert ids(G.reach(spark, e.limit(0), seed(spark, "a", None, "a"), 3)) == ["a"]


def test_closure_ends_on_cycles(spark, graph):
    _, e = graph
    assert ids(G.closure(spark, e, seed(spark, "a")), "id", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("gone", 4)]


def test_closure_follows_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(18)], "source string, target string")
    got = G.closure(spark, chain, seed(spark, "n0")).collect()
    assert sorted(r.level for r in got) == list(range(19))


def test_lookup(spark, graph):
    n, e = graph
    got = G.lookup(spark, n, e, "a", 0)
    assert ids(got["neighbours"]) == [] and len(ids(got["outgoing"])) == 2 and ids(got["found"]) == ["a"]
    assert ids(G.lookup(spark, n, e, "nope", 1)["found"]) == []
    with pytest.raises(ValueError):
        G.lookup(spark, n, e, "a", 4)


def test_dangling_and_induced(spark, graph):
    n, e = graph
    assert ids(G.dangling(e, n)) == ["d|x|gone", "x|a"]  # a null end is no node
    assert ids(G.induced(e, n.filter("id in ('a','b')"))) == ["a|x|b", "a|y|b"]
    assert ids(G.checked(n.unionByName(n.limit(1)), e), "fault") == ["dangling-edge", "dangling-edge", "duplicate-node"]


def test_kind_pass_and_traversal(spark, graph):
    _, e = graph
    assert ids(G.slice_graph(spark, e, seed(spark, "b"), 1, "outgoing", ["y"])) == ["b", "c", "d"]
    # traversed edges are those at a frontier, not the induced ones
    assert ids(G.traversed(spark, e, seed(spark, "b"), 1)) == ["a|x|b", "a|y|b", "b|x|c"]
    assert ids(G.traversed(spark, e, seed(spark, "b"), 0)) == []


def test_data_flow_keeps_its_cap_and_order(spark):
    pairs = [("hub", "f", f"n{i:02d}") for i in range(10)] + [(f"n{i:02d}", "f", f"m{i:02d}") for i in range(10)]
    e = spark.createDataFrame(pairs, "source string, kind string, target string").withColumn("id", G.edge_id(F.col("source"), F.col("kind"), F.col("target")))
    got = G.data_flow(spark, e, seed(spark, "hub"), ["f"], 3, 12)
    assert ids(got, "rank", "id") == [(i + 1, f"n{i:02d}") for i in range(10)] + [(11, "m00"), (12, "m01")]
    assert G.data_flow(spark, e, seed(spark, "hub"), ["f"], 0).count() == 0


def test_identities(spark):
    rows = spark.createDataFrame([("a", "b", "export-all"), ("a", "b", "re-export"), ("a", "b", "re-export"), ("a", "c", "import")], "source string, target string, dep string")
    assert ids(G.primary_kind(rows)) == ["a--depends-on-->b", "a--depends-on-->b#export-all", "a--imports-->c"]
    calls = spark.createDataFrame([("a", "calls", "b", 7), ("a", "uses", "b", 7)], "s string, k string, t string, l int")
    assert ids(calls.select(G.edge_id(F.col("s"), F.col("k"), F.col("t"), F.col("l")).alias("id"))) == ["a--calls-->b@7", "a--uses-->b"]
    decl = spark.createDataFrame([("p", "", "f", 9, 0), ("p", "", "f", 2, 1), ("p", "o", "f", 1, 2)], "path string, owner string, name string, line int, i int")
    assert ids(G.ordinals(decl, "path", "owner", "name", "line", "i"), "line", "ordinal") == [(1, 0), (2, 0), (9, 1)]


def test_view_cap_and_text(spark, graph):
    n, e = graph
    nodes, near = G.view(n.withColumn("kind", F.when(F.col("id") == "a", "q").otherwise("k")), e, ["q"])
    assert ids(nodes) == ["a", "b", "c"] and len(ids(near)) == 3 + 1  # with the edge from nowhere
    assert ids(G.capped_with_focus(n, "e", 2, ["id"])) == ["a", "e"]
    odd = spark.createDataFrame([('a"b', "k", "x\\y")], "id string, kind string, label string")
    assert [r.line for r in G.dot_lines(odd, e.limit(0)).collect()][1] == '  "a\\"b" [label="x\\\\y"];'
