import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.operators import context as C
from weftline.operators import diff as D
from weftline.operators import exact_scan as E
from weftline.operators import resolve as V
from weftline.operators import rules as R
from weftline.operators import text_search as S
from weftline.plans import diff_queries


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def fields(spark, *r):
    return spark.createDataFrame(list(r), "kind string, id string, path string, field string, text string, weight int")


def test_scorer(spark):
    f = fields(spark, ("n", "1", None, "label", "User table", 6), ("n", "2", None, "label", "user", 6), ("n", "3", None, "label", "none", 6), ("n", "4", None, "label", None, 6))
    assert rows(S.relevance(f, "user"), "id", "score") == [("1", 28), ("2", 28)]  # twice as phrase, once as term, and the bonus
    assert rows(S.relevance(f, "user user"), "id", "score") == [("1", 6), ("2", 6)]  # a repeated term forfeits the bonus
    assert rows(S.relevance(f, "user table"), "id", "score") == [("1", 12 + 12 + 10), ("2", 6)]
    assert rows(S.relevance(f, ""), "id") == []
    assert rows(S.relevance(f.limit(0), "user")) == []


def test_equal_reasons_count_once_by_their_short_text(spark):
    a, b = "user " + "x" * 130 + "1", "user " + "x" * 130 + "2"
    f = fields(spark, ("n", "1", None, "label", a, 6), ("n", "1", None, "label", b, 6), ("n", "1", None, "path", a, 8))
    assert rows(S.relevance(f, "user"), "score") == [(6 * 3 + 8 * 3 + 10,)]


def test_ranking_and_scope(spark):
    s = spark.createDataFrame([("b", "2", None, 5), ("a", "9", "p", 5), ("a", "1", "q", 5), ("a", "0", "q", 9)], "kind string, id string, path string, score int")
    assert [r.id for r in S.ranked(s, 3).collect()] == ["0", "9", "1"]
    pool = fields(spark, ("n", "src/a", "src/a", "f", "t", 1), ("n", "z", "src/b", "f", "t", 1))
    assert rows(S.scoped(pool, "z"), "id") == [("z",)]
    assert rows(S.scoped(pool, "find src/a"), "id") == [("src/a",)]
    assert len(rows(S.scoped(pool, "else"))) == 2


def docs(spark, *r):
    return spark.createDataFrame(list(r), "id int, text string, line string")


def test_literal_scan(spark):
    d = docs(spark, (1, "aaa\r\nxaax😀aa\n", ""), (2, None, ""), (3, "", ""), (4, "none", ""))
    assert rows(E.matches(d, "id", "text", "aa"), "id", "line", "column") == [(1, 1, 1), (1, 2, 2), (1, 2, 6)]
    with pytest.raises(ValueError):
        E.matches(d, "id", "text", "")
    assert rows(E.capped(E.matches(d, "id", "text", "aa"), "id", 2), "line", "column", "total", "truncated") == [(1, 1, 3, True), (2, 2, 3, True)]
    w = E.window_around(E.matches(docs(spark, (1, "a\nb\nX\nd", "")), "id", "text", "X"), docs(spark, (1, "a\nb\nX\nd", "")), "id", "text", 1, 5)
    assert rows(w, "from_line", "to_line", "context") == [(2, 4, "b\nX\nd")]


def test_match_kinds(spark):
    cases = {'if (a === "X': "usage", 'f("X': "usage", "f(a, X": "usage", "const a = X": "declaration", 'name="X': "usage", "key: 'X": "declaration", "X": "unknown"}
    df = spark.createDataFrame([(k, k.rindex("X") + 1) for k in cases], "l string, c int")
    got = dict(df.select("l", E.match_kind(F.col("l"), F.col("c")).alias("k")).collect())
    assert got == cases


def test_slices_and_pages(spark):
    d = docs(spark, (1, "a\nb\nc", ""), (2, "", ""), (3, None, ""))
    assert rows(E.line_slice(d, "id", "text", 2, 5), "id", "end_line", "slice") == [(1, 3, "b\nc"), (2, 0, "")]
    p = spark.range(10).toDF("k")
    assert [r.k for r in E.page(p, ["k"], 4, 2).orderBy("k").collect()] == [8, 9] and E.page(p, ["k"], 4, 3).count() == 0


def test_keyed_diff(spark):
    s = "k int, a string, before string"
    b = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "z", "q"), (None, "n", None)], s)
    a = spark.createDataFrame([(1, "y", None), (2, None, None), (4, "w", None)], s)
    got = D.keyed_diff(b, a, "k", ["a", "before"])
    assert [(r.k, r.change, r.changed_fields) for r in got.orderBy("k").collect()] == [(1, "changed", ["a"]), (3, "removed", None), (4, "added", None)]
    assert D.keyed_diff(b.limit(0), a.limit(0), "k", ["a"]).count() == 0


def test_every_changed_field_has_its_values(spark):
    named = {(r.o_orderkey, f) for r in diff_queries.diff_nodes(spark, SF).collect() if r.change == "changed" for f in r.changed_fields.split(",")}
    got = diff_queries.diff_changed_fields(spark, SF).collect()
    assert len(got) == len(named) and {(r.o_orderkey, r.field) for r in got} == named and {f for _, f in named} == {"o_orderstatus", "o_totalprice"}
    assert all(float(r.after) == pytest.approx(float(r.before) + 1) for r in got if r.field == "o_totalprice")
    assert all(r.before and r.after is None for r in got if r.field == "o_orderstatus")


def test_bags_cancel_by_multiplicity(spark):
    s = "identity string, pair string, g string"
    b = spark.createDataFrame([("same", "p0", "g0"), ("b1", "p1", "g1"), ("b2", "p2", "g2"), ("b3", "p3", "g3"), ("b4", "p3", "g3")], s)
    a = spark.createDataFrame([("same", "p0", "g0"), ("a1", "q1", "g1"), ("a2", "p2", "h2"), ("a3", "p3", "h3")], s)
    assert rows(D.bag_diff(b, a, ["g"], "pair", "identity")) == [("a2", "changed"), ("a3", "added"), ("b2", "changed"), ("b3", "removed"), ("b4", "removed")]


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([(i, str(i)) for i in range(20)], "k int, h string")
    new = spark.createDataFrame([(i, str(i) if i % 3 else "changed") for i in range(5, 25)], "k int, h string")
    c = D.change_classes(old, new, "k", "h")
    fresh = new.join(c.filter(F.col("class").isin("added", "changed")), "k", "left_semi")
    assert rows(D.reuse_merge(old, fresh, "k", c.filter(F.col("class") == "removed"))) == rows(new)
    a, b = D.fingerprint({"x": "1", "y": "2"}), D.fingerprint({"y": "2", "x": "1"})
    assert spark.range(1).select(a == b, a == D.fingerprint({"x": "1", "y": "3"})).first() == (True, False)


def test_conflicts_are_kept(spark):
    df = spark.createDataFrame([("src/validateAnalyzer.ts",), ("tests/a.spec.ts",), ("x.bin",), ("src/generated/package.json",)], "p string")
    got = {r.p: (r.v["conflict"], [(c.role, c.confidence) for c in r.v["classes"]], r.g) for r in df.select("p", R.resolve(R.file_rules(F.col("p"))).alias("v")).withColumn("g", R.guidance(F.col("v.classes"))).collect()}
    assert got["src/validateAnalyzer.ts"] == (False, [("analyzer", "likely")], "safe-primary-edit-target")
    assert got["tests/a.spec.ts"] == (False, [("test-fixture", "certain")], "test-only")
    assert got["x.bin"] == (False, [], "uncertain")
    assert got["src/generated/package.json"] == (True, [("generated-file", "possible"), ("configuration-file", "possible")], "generated-do-not-edit")


def test_confidence_merges_go_opposite_ways(spark):
    df = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", None), ("c", "odd"), ("c", "medium")], "k string, c string")
    assert rows(R.merged_confidence(df, ["k"], "c", R.REACH_LEVELS, True)) == [("a", "low"), ("b", None), ("c", None)]
    assert rows(R.merged_confidence(df, ["k"], "c", R.REACH_LEVELS, False)) == [("a", "high"), ("b", None), ("c", "medium")]
    up = spark.createDataFrame([(1, "k", None, "low", ["b"]), (2, "k", "x", "high", ["a", "b"]), (3, "k", "y", None, [])], "o int, k string, s string, c string, e array<string>")
    got = R.upsert(up, "k", "o", ["s"], "c", R.REACH_LEVELS, "e").first()
    assert (got.k, got.s, got.c, got.e) == ("k", "x", "high", ["a", "b"])


def test_focus(spark):
    def confidence(*scores):
        return C.focus(spark.createDataFrame([(f"n{i}", s) for i, s in enumerate(scores)], "id string, score int")).first().confidence

    assert [confidence(*s) for s in ((5,), (50, 40), (50, 49), (50, 46), (10, 0), (3, -5), (100, 92))] == ["high", "high", "low", "medium", "high", "high", "medium"]
    ties = C.near_ties(spark.createDataFrame([("a", 50), ("b", 50), ("c", 43), ("d", 41)], "id string, score int"))
    assert rows(ties) == [("b", 0), ("c", 7)]


def test_retained_keeps_the_tail(spark):
    df = spark.createDataFrame([(f"n{i}", i) for i in range(5)], "id string, score int")
    got = rows(C.retained(df, [F.desc("score"), "id"], 2), "id", "retained", "drop_reason")
    assert got[0] == ("n0", False, "over-cap") and sum(r[1] for r in got) == 2 and len(got) == 5


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([("x", 1, 60), ("x", 2, 50), ("x", 3, 40), ("x", 4, 1), ("y", 1, None)], "b string, o int, s int")
    assert rows(C.pack(df, "b", "o", "s", 100, 5), "b", "o", "included") == [("x", 1, True), ("x", 2, False), ("x", 3, True), ("x", 4, False), ("y", 1, True)]
    assert rows(C.pack(df, "b", "o", "s", 1000, 2), "o", "included")[-1] == (4, False)
    assert C.pack(df.limit(0), "b", "o", "s", 10, 2).count() == 0


def test_allocation_spills_over(spark):
    g = spark.createDataFrame([("a", 1, 10, 4, 20), ("b", 2, 0, 4, 4), ("c", 3, 9, 4, 5)], "grp string, position int, available int, reservation int, hard_limit int")
    assert rows(C.allocate(g)) == [("a", 10, 8), ("b", 0, 0), ("c", 9, 4)]


def test_interval_merges(spark):
    df = spark.createDataFrame([("f", 1, 1, 3), ("f", 2, 10, 12), ("f", 3, 3, 10), ("g", 1, 5, 5), ("g", 2, None, 1)], "f string, o int, a long, b long")
    assert rows(C.merge_in_order(df, "f", "o", "a", "b")) == [("f", 1, 10), ("f", 10, 12), ("g", 5, 5)]
    assert rows(C.merge_sorted(df.filter("a is not null"), "f", "a", "b")) == [("f", 1, 12), ("g", 5, 5)]


def test_rates_and_verdicts(spark):
    df = spark.createDataFrame([("a", "pass"), ("a", "fail"), ("b", "skip"), ("c", "pass"), ("d", "blocked"), ("d", "fail")], "k string, s string")
    s = F.col("s")
    got = df.groupBy("k").agg(C.pass_rate(s == "pass", s.isin("pass", "fail")).alias("r"), C.verdict(s == "blocked", s == "fail").alias("v"))
    assert rows(got) == [("a", 0.5, "REGRESSION"), ("b", None, "PASS"), ("c", 1.0, "PASS"), ("d", 0.0, "BLOCKED")]
    assert C.heading_order(iter([1, 4, 9])) and not C.heading_order(iter([2, 1]))


def test_boosts_exclude_each_other(spark):
    flags = {k: F.lit(True) for k in C.BOOSTS["none"]}
    got = spark.range(1).select(C.boost("implementation", flags), C.boost("none", {}), C.boost("none", {"focus_file": F.lit(None).cast("boolean")})).first()
    assert tuple(got) == (500 + 40 + 10 + 45 + 35 + 10 + 5, 0, 0)


def test_imports(spark):
    inv = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/b/index.ts", "src/c.tsx", "lib/d.ts", "e.js")], "repo string, path string")
    imp = spark.createDataFrame([("r", "src/x.ts", s) for s in ("./a", "./b", "./c.jsx", "../lib/d.js", "./nope", "react", "../e")] + [("q", "src/x.ts", "./a")], "repo string, importer string, specifier string")
    got = {(r.repo, r.specifier): (r.status, r.target) for r in V.resolve_imports(imp, inv, ["repo"]).collect()}
    assert got[("r", "./a")] == ("resolved", "src/a.ts") and got[("r", "./b")] == ("resolved", "src/b/index.ts")
    assert got[("r", "./c.jsx")] == ("resolved", "src/c.tsx") and got[("r", "../lib/d.js")] == ("resolved", "lib/d.ts") and got[("r", "../e")] == ("resolved", "e.js")
    assert got[("r", "./nope")] == ("unresolved", None) and got[("r", "react")] == ("external", None) and got[("q", "./a")] == ("unresolved", None)


def test_aliases(spark):
    rules = spark.createDataFrame([("@a/*", "x/*"), ("@a/b", "y"), ("@a/bb*", "z/*"), ("@t/*", "1/*"), ("@t/*", "2/*"), ("@a/*.css", "css/*")], "pattern string, replacement string")
    specs = spark.createDataFrame([("@a/b",), ("@a/bbq",), ("@a/c",), ("@t/x",), ("other",)], "specifier string")
    want = {"@a/b": "y", "@a/bbq": "z/q", "@a/c": "x/c", "@t/x": None, "other": None}
    assert dict(V.resolve_aliases(specs, rules).collect()) == want
    catch = lambda *r: dict(V.resolve_aliases(specs, rules.unionByName(spark.createDataFrame(list(r), rules.schema))).collect())["other"]
    assert catch(("*", "any/*")) == "any/other" and catch(("*", "any/*"), ("*r", "r/*")) is None and catch(("*", "any/*"), ("*q", "q/*")) == "any/other"


def test_qualification_and_selection(spark):
    calls = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "call int, k string")
    ends = spark.createDataFrame([("e1", "a"), ("e2", "b"), ("e3", "b"), ("e3", "b"), ("e4", None)], "endpoint string, k string")
    assert rows(V.qualify(calls, ends, ["k"]), "call", "qualification", "target", "candidates") == [
        (1, "RESOLVED", "e1", None), (2, "AMBIGUOUS", None, "e2|e3"), (3, "UNRESOLVED", None, None), (4, "UNRESOLVED", None, None)]
    one = R.single_match(spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "1"), ("y", "2"), ("z", None)], "l string, r string"), "l", "r")
    assert rows(one) == [("x", "found", "1", 1), ("y", "ambiguous", None, 2), ("z", "not-found", None, 0)]
    c = V.cascade(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "k string, v int"), "k", [("one", F.col("v") == 1), ("two", F.col("v") == 2)])
    assert rows(c) == [("a", "one"), ("b", "two")]
    with pytest.raises(ValueError):
        V.relationship_query(calls, {}, ["call"], 257)


def test_target_proof(spark):
    t = spark.createDataFrame([("src/a",), ("src/b",), ("doc/c",), ("../x",)], "path string")
    got = dict(V.target_proof(t, spark.createDataFrame([("src/a",)], "path string"), ["src"]).collect())
    assert got == {"src/a": "present", "src/b": "proven-missing", "doc/c": "outside-selected-roots", "../x": "indeterminate"}


def test_modes(spark):
    df = spark.createDataFrame(pd.DataFrame({"path": ["README.md", "src/a.ts", "tests/b.ts"], "score": [10, 10, 10], "g": ["docs-only", "safe-primary-edit-target", "test-only"]}))
    f = lambda mode, n: [r[0] for r in df.orderBy("path").select(C.adjusted(F.col("path"), F.col("score"), F.lit(n), mode, F.col("g"), F.lit("src"))).collect()]
    assert f("feature-add", 1) == [10 - 20 - 4, 16, 12] and f("feature-add", 2)[0] == 6 and f("subsystem", 2) == [10, 14, 10]
