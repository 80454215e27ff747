"""Calls through import bindings, Rust relations, deep mounts, evidence, requests and the trusted baseline."""

import json

import pytest

from weftline.operators import bundle, calls, diff, entries, evidence, rust
from weftline.plans.engine import CodeIndex
from weftline.session import scratch, write_text_atomic
from weftline.sources import extract
from weftline.sources.artifacts import ArtifactStore

FILES = {
    "src/m.ts": "export function one() {}\nexport default function two() {}\nfunction hidden() {}\nexport { hidden as shown };\nexport const three = () => 1;\nexport interface T {}\n",
    "src/c.js": "function four() {}\nfunction five() {}\nmodule.exports = { four, fifth: five };\n",
    "src/a.ts": """import two, { one as uno, shown, three, T, missing } from './m';
import * as all from './m';
import { four } from './c.js';
import { x } from 'pkg';
function caller() { uno(); two(); shown(); three(); missing(); x(); all.one(); all.nothing(); four(); local(); T(); }
function shadowed(uno) { uno(); { const three = 1; three(); } }
function local() {}
uno();
""",
    "src/b.js": "const c = require('./c');\nconst { four: f4 } = require('./c');\nconst run = () => { c.fifth(); c.four(); f4(); };\n",
    "p.py": "def a():\n    b()\n    self.a()\ndef b(): pass\nclass C:\n    def m(self):\n        self.n()\n    def n(self): pass\n",
    "L.java": "class L { void f() { g(); h(); over(); } void g() {} void over() {} void over(int x) {} }\n",
}


def frame(spark, files, scope="r"):
    return spark.createDataFrame([(scope, p, t) for p, t in files.items()], "repo string, path string, content string")


def test_callees_are_known_through_bindings(spark):
    df = frame(spark, FILES)
    got = calls.edges(extract.extract_files(df, ["repo"]), df.select("repo", "path")).collect()
    by = {(r.path, r.caller, r.callee): (r.target, r.symbol, r.symbol_line, r.resolution) for r in got}
    a = "src/a.ts"
    assert by[a, "caller", "uno"] == ("src/m.ts", "one", 1, "import") and by[a, "caller", "two"] == ("src/m.ts", "two", 2, "import")
    assert by[a, "caller", "shown"] == ("src/m.ts", "hidden", 3, "import") and by[a, "caller", "three"] == ("src/m.ts", "three", 5, "import")
    assert by[a, "caller", "all.one"] == ("src/m.ts", "one", 1, "import") and by[a, "caller", "four"] == ("src/c.js", "four", 1, "import")
    for name in ("missing", "x", "all.nothing"):
        assert by[a, "caller", name] == (None, None, None, "unknown")
    assert by[a, "caller", "local"][3] == "shadowed" and by[a, "caller", "T"][3] == "unknown"  # names of the file are no import
    assert by[a, "shadowed", "uno"][3] == "shadowed" and by[a, "shadowed", "three"][3] == "shadowed"
    assert not [k for k in by if k[0] == a and k[1] == ""]  # a call outside functions is no edge
    b = "src/b.js"
    assert by[b, "run", "c.fifth"] == ("src/c.js", "five", 2, "import") and by[b, "run", "c.four"][1] == by[b, "run", "f4"][1] == "four"
    assert by["p.py", "a", "b"] == ("p.py", "b", 4, "local") and by["p.py", "C.m", "self.n"] == ("p.py", "n", 8, "local")
    assert by["L.java", "f", "g"][3] == "local" and by["L.java", "f", "h"][3] == by["L.java", "f", "over"][3] == "unknown"


def test_calls_of_an_index(spark):
    rows = [(p, t.encode(), len(t)) for p, t in FILES.items()]
    ix = CodeIndex(spark, scratch(spark, "ix")).build_from(spark.createDataFrame(rows, "rel_path string, content binary, size_bytes long"))
    got = {(r.source.split("#")[-1], r.target.split("#")[-1]) for r in ix.edges.filter("kind = 'calls'").collect()}
    assert {("caller", "one"), ("caller", "two"), ("run", "five"), ("a", "b")} <= got and not any(s == "shadowed" for s, _ in got)


def test_rust_relations(spark):
    files = {
        "src/lib.rs": "mod a;\nmod b;\nmod gone;\nuse crate::a::T;\nuse b::{S as Z, Twice};\nstruct Own;\nimpl T for Own {}\nimpl Local for Own {}\ntrait Local: T {}\nimpl Far for Own {}\nimpl Twice for Own {}\n",
        "src/a.rs": "pub trait T {}\npub trait Twice {}\n", "src/b.rs": "pub struct S;\npub trait Twice {}\n",
    }
    df = frame(spark, files)
    got = {(r.kind, r.source, r.target): (r.target_path, r.status) for r in rust.relations(extract.extract_files(df, ["repo"]), df.select("repo", "path")).filter("path = 'src/lib.rs'").collect()}
    assert got["implements", "Own", "T"] == ("src/a.rs", "resolved") and got["implements", "Own", "Local"] == ("src/lib.rs", "resolved")
    assert got["implements", "Own", "Far"] == (None, "unresolved") and got["implements", "Own", "Twice"] == (None, "ambiguous")
    assert got["supertrait", "Local", "T"] == ("src/a.rs", "resolved") and got["uses", "src/lib.rs", "b::S"] == ("src/b.rs", "resolved")
    assert got["module", "src/lib.rs", "a"] == ("src/a.rs", "resolved") and got["module", "src/lib.rs", "gone"][1] == "unresolved"


def test_mounts_at_any_depth(spark):
    joins = [("f", f"r{i}", f"/{i}", f"r{i + 1}") for i in range(6)] + [("f", "loop", "/l", "pool"), ("f", "pool", "/p", "loop"), ("f", "top", "/t", "loop")]
    routes = [("f", "r6", "GET", "/x"), ("f", "pool", "PUT", "/y")]
    got = bundle.mounts(spark, spark.createDataFrame(routes, "scope string, router string, method string, path string"), spark.createDataFrame(joins, "scope string, router string, prefix string, child string"))
    assert sorted(tuple(r) for r in got.collect()) == [("f", "GET", "/0/1/2/3/4/5/x"), ("f", "PUT", "/t/l/y")]


def test_expectation_families(spark):
    e = [("s", "t", "forbidden", "1", 1), ("s", "t", "forbidden", "2", 1), ("s", "t", "forbidden", "2", None), ("s", "t", "at-most", None, 2), ("s", "t", "at-most", None, 1), ("s", "none", "at-most", None, 0)]
    r = spark.createDataFrame([("t", "1", 1), ("t", "2", 2)], "task string, id string, rank int")
    got = bundle.evaluate(spark.createDataFrame(e, "suite string, task string, category string, id string, top_k int"), r)
    assert sorted((x.category, x.id or "", x.passed) for x in got.collect()) == [
        ("at-most", "", False), ("at-most", "", True), ("at-most", "", True), ("forbidden", "1", False), ("forbidden", "2", False), ("forbidden", "2", True)]


def test_marked_first_keeps_all(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 7)], "k string, o int")
    got = diff.marked_first(df, "k", "o", 64, "n").collect()
    assert len(got) == 501 and {r.o for r in got if r.listed and r.k == "hot"} == set(range(64)) and {r.n for r in got if r.k == "hot"} == {500}


def test_entries(spark):
    sym = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "id string")
    known = spark.createDataFrame([("a", "view-model", "certain"), ("b", "x", "likely"), ("b", "y", "likely"), ("b", "z", "possible"), ("d", "database-model", None), ("d", None, "certain")], "id string, role string, confidence string")
    reach = spark.createDataFrame([("a", "view-model", True), ("d", "route-handler", None)], "id string, role string, gated boolean")
    got = {r.id: r for r in entries.symbol_entries(sym, known, reach).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].uncertainty, got["a"].guidance, got["a"].readiness) == ("certain", "safe-primary-edit-target", "ready")
    assert (got["b"].roles, got["b"].uncertainty, got["b"].readiness) == (["x", "y"], "possible", "risky-assumption")
    assert (got["c"].uncertainty, got["c"].guidance) == ("unknown", "uncertain") and got["d"].conflict
    assert got["d"].risks == ["public-contract-risk", "unreachable-ui-risk", "wrong-layer-risk"]


def test_evidence_groups_keep_the_best_and_count_the_rest(spark):
    items = spark.createDataFrame([("g", f"i{i}", i % 7, f"p{i}") for i in range(300)] + [("g", "i6", 99, "p6"), ("g", None, 100, "p"), ("other", "i1", 1, "p")], "grp string, id string, score int, path string")
    limits = spark.createDataFrame([("g", 3), ("empty", 2)], "grp string, most int")
    chosen, summary = evidence.evidence_groups(items, limits)
    assert [(r.id, r.rank) for r in chosen.orderBy("rank").collect()] == [("i6", 1), ("i104", 2), ("i111", 3)]
    assert {r.grp: (r.available, r.selected, r.dropped) for r in summary.collect()} == {"g": (300, 3, 297), "empty": (0, 0, 0)}


def test_responsibilities(spark):
    asked = spark.createDataFrame([("s", f"R{i:02}", i, i == 29) for i in range(30)] + [("s", "R01", 0, False), ("t", "R", 1, None)], "scope string, responsibility string, position int, critical boolean")
    ev = spark.createDataFrame([("s", "g", c) for c in ("production", "contract", "test", "oracle")], "scope string, grp string, category string")
    got = {(r.scope, r.responsibility): r for r in evidence.responsibilities(asked, ev).collect()}
    assert len(got) == 31 and got["s", "R01"].position == 0 and got["s", "R00"].status == "mapped" and got["t", "R"].status == "unmapped"
    assert {k[1] for k, r in got.items() if k[0] == "s" and not r.retained} == {"R24", "R25", "R26", "R27", "R28"}
    assert {r.status for r in evidence.responsibilities(asked, ev, True).filter("scope = 's'").collect()} == {"partially-mapped"}


def test_requests():
    got = evidence.merge_request({"query": "A b"}, {"query"}, {"query": "a  B", "mode": "x"}, {"limit": 3})
    assert got == {"limit": (3, "default"), "query": ("A b", "equivalent-duplicate"), "mode": ("x", "request-file")}
    with pytest.raises(ValueError):
        evidence.merge_request({"query": "a"}, {"query"}, {"query": "b"}, {})


def test_trusted_baseline(spark):
    store = ArtifactStore(spark, scratch(spark, "base"))
    assert store.trusted(["t"], "f", ["1"]) == ("unavailable", "cache-missing")
    store.publish({"t": (spark.range(5), "1")})
    store.seal("f")
    assert store.trusted(["t"], "f", ["1"]) == ("trusted", "")
    assert store.trusted(["t"], "g", ["1"]) == ("incompatible", "config-mismatch") and store.trusted(["t"], "f", ["2"]) == ("incompatible", "t-incompatible")
    assert store.trusted(["t", "u"], "f", ["1"]) == ("unavailable", "u-missing")
    folder = store.manifest()["artifacts"]["t"]["folder"]
    spark.range(4).write.mode("overwrite").parquet(f"{store.path}/{folder}")
    assert store.trusted(["t"], "f", ["1"]) == ("unsafe", "t-hash-mismatch")
    write_text_atomic(spark, f"{store.path}/cache-{1:012d}.json", json.dumps({"manifest": "../x.json", "sha256": "", "fingerprint": "f"}))
    assert store.trusted(["t"], "f", ["1"]) == ("unsafe", "artifact-path-escape")


def test_gradle():
    text = 'include ":a", ":b"\n// implementation("no:no:1")\ndependencies {\n  implementation(project(path = ":c")) ; api "x:y:1"\n  testImplementation platform("p:q:2")\n}\nplugins { id("k") }\n'
    assert [(r[1], r[2], r[3]) for r in extract.extract_gradle("build.gradle", text)] == [(":a", "include", 1), (":b", "include", 1), (":c", "project", 4), ("x:y:1", "api", 4), ("p:q:2", "testImplementation", 5), ("k", "id", 7)]
