from pyspark.sql import functions as F

from weftline.operators import bundle as B


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bundles_are_bounded_and_keep_the_tail(spark):
    text = "def a():\n  b(); c(); d()\n" + "def b():\n" + "  x\n" * 290 + "def c():\n  1\n" + "def d():\n" + "  y\n" * 20
    sym = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 3, 293), (1, "c", 294, 295), (1, "d", 296, 316), (1, "e", 316, None)], "k int, name string, line int, end_line int")
    got = {(r.primary, r.name): (r.lines, r.included) for r in B.bundles(sym, spark.createDataFrame([(1, text)], "k int, content string"), ["k"]).collect()}
    assert got[("a", "a")] == (2, True) and got[("a", "b")] == (291, True) and got[("a", "c")] == (2, True) and got[("a", "d")] == (21, False)
    assert ("a", "e") not in got and got[("c", "c")] == (2, True)


def test_bundles_keep_every_declaration_of_a_name(spark):
    text = "struct S {\n}\nimpl S {\n  fn f() {}\n}\nimpl T for S {\n}\nfn g() -> S {\n}\n"
    sym = spark.createDataFrame([(1, "S", 1, 2), (1, "S", 3, 5), (1, "S", 6, 7), (1, "S", 6, 6), (1, "g", 8, 9)], "k int, name string, line int, end_line int")
    got = rows(B.bundles(sym, spark.createDataFrame([(1, text)], "k int, content string"), ["k"]).select("primary", "primary_line", "name", "line", "lines", "included"))
    blocks = {1: 2, 3: 3, 6: 2}
    assert got == sorted([(*p, "S", n, size, True) for p in (("S", 1), ("S", 3), ("S", 6), ("g", 8)) for n, size in blocks.items()] + [("g", 8, "g", 8, 2, True)], key=str)


def test_mounts(spark):
    routes = spark.createDataFrame([("f", "r", "GET", "/x"), ("f", "app", "GET", "/top"), ("f", "self", "GET", "/loop"), ("g", "r", "GET", "/x")], "scope string, router string, method string, path string")
    joins = spark.createDataFrame([("f", "app", "/api/", "r"), ("f", "mid", "/m", "r"), ("f", "app", "/v", "mid"), ("f", "self", "/s", "self")], "scope string, router string, prefix string, child string")
    assert rows(B.mounts(spark, routes, joins)) == [("f", "GET", "/api/x"), ("f", "GET", "/top"), ("f", "GET", "/v/m/x"), ("g", "GET", "/x")]


def test_modules(spark):
    decl = spark.createDataFrame([("src/lib.rs", "a"), ("src/lib.rs", "b"), ("src/x.rs", "c"), ("src/lib.rs", "gone")], "path string, name string").withColumn("s", F.lit("r"))
    inv = spark.createDataFrame([(p,) for p in ("src/a.rs", "src/b.rs", "src/b/mod.rs", "src/x/c.rs", "src/gone.txt")], "path string").withColumn("s", F.lit("r"))
    got = {(r.path, r.name): (r.status, r.target) for r in B.module_files(decl, inv, ["s"]).collect()}
    assert got == {("src/lib.rs", "a"): ("resolved", "src/a.rs"), ("src/lib.rs", "b"): ("ambiguous", None), ("src/x.rs", "c"): ("resolved", "src/x/c.rs"), ("src/lib.rs", "gone"): ("unresolved", None)}


def test_evaluation_and_capsule(spark):
    e = spark.createDataFrame([("s", "t", "c", "1", 1), ("s", "t", "c", "2", 1), ("s", "t", "c", "3", 5)], "suite string, task string, category string, id string, top_k int")
    r = spark.createDataFrame([("t", "1", 1), ("t", "2", 2)], "task string, id string, rank int")
    assert {x.id: x.passed for x in B.evaluate(e, r).collect()} == {"1": True, "2": False, "3": False}
    docs = spark.createDataFrame([(1, "a\n" * 200, "p"), (2, None, None)], "k long, t string, p string")
    top = spark.createDataFrame([(1, 9, 1), (2, 8, 2), (3, 7, 3)], "id long, score int, rank int")
    assert [(x.k, x.end_line, x.truncated, x.next_line) for x in B.capsule(top, docs, "k", "t", "p").orderBy("rank").collect()] == [(1, 160, True, 161), (2, 0, False, None)]
