import os

import pytest
from pyspark.sql import functions as F

from weftline.operators.incremental import ContentState
from weftline.session import scratch
from weftline.sources import extract as X
from weftline.sources import scan
from weftline.sources.artifacts import ArtifactStore
from weftline.streaming import incremental as I


def test_scan(spark, tmp_path):
    files = {"src/a.ts": b"x", "src/b.d.ts": b"y", "node_modules/c.js": b"z", "out.py": b"1", "skip/d.py": b"2", "e.txt": b"3", "bad.rs": b"\xff\xfe"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    led = scan.scan(spark, str(tmp_path), ["skip"])
    got = {r.rel_path: (r.status, r.language) for r in led.collect()}
    assert got == {
        "src/a.ts": ("supported", "typescript"), "src/b.d.ts": ("declaration-file", "typescript"), "node_modules/c.js": ("ignored-folder", "javascript"),
        "out.py": ("supported", "python"), "skip/d.py": ("user-excluded", "python"), "e.txt": ("unsupported", None), "bad.rs": ("unreadable", "rust"),
    }
    assert {r.status: r.files for r in scan.counters(led).collect()}["supported"] == 2
    assert [r.rel_path for r in scan.largest(led, 1).collect()] == ["bad.rs"]
    assert scan.samples(led, 1).filter("status = 'supported'").first().rel_path == "out.py"


def test_artifacts(spark):
    store = ArtifactStore(spark, scratch(spark, "artifacts"))
    store.publish({"t": (spark.range(5).withColumn("a", F.array("id")), "1.0.0")})
    assert store.read("t", ["1.0.0"], verify=True).count() == 5
    with pytest.raises(ValueError):
        store.read("t", ["2"])
    with pytest.raises(KeyError):
        store.read("other")
    assert store.publish({"u": (spark.range(1), "1")}) == 2 and store.read("t").count() == 5
    folder = store.manifest()["artifacts"]["t"]["folder"]
    spark.range(4).withColumn("a", F.array("id")).write.mode("overwrite").parquet(f"{store.path}/{folder}")
    with pytest.raises(ValueError):
        store.read("t", verify=True)


def facts(path, text):
    import re

    return X._registry[re.search(r"\.\w+$", path).group()](path, text)


def names(rows, record, *more):
    pick = lambda r: tuple(r[X.FIELDS.index(f)] for f in ("name", *more))
    return [pick(r) for r in rows if r[0] == record]


def test_python_facts():
    rows = facts("a.py", "from .x import y as z\nimport os\n@app.get('/u')\ndef f(a, b):\n    return g(a)\nclass M(Base):\n    id = Column(Integer)\n    def _m(self): pass\n")
    assert names(rows, "symbol", "kind", "line", "end_line", "exported", "owner") == [("f", "function", 4, 5, True, ""), ("M", "class", 6, 8, True, ""), ("_m", "method", 8, 8, False, "M")]
    assert names(rows, "import", "kind", "detail") == [(".x", "named", "z"), ("os", "module", "os")]
    assert names(rows, "route", "kind", "owner") == [("/u", "GET", "f")]
    assert ("g", "f") in names(rows, "call", "owner") and names(rows, "model_field", "owner") == [("id", "M")]
    assert names(facts("b.py", "def ("), "warning") == [("not parsed",)]
    long = names(facts("c.py", f"x = '{'y' * 500}'"), "literal")
    assert len(long[0][0]) == 256


def test_a_long_callee_keeps_its_name():
    chain = "q" + "".join(f".where(column_{i} == {i})" for i in range(40))
    (long,) = [r[1] for r in facts("a.py", f"def f():\n    {chain}.finish()\n") if r[0] == "call" and len(r[1]) > 600 and r[1].endswith(".finish")]
    assert long == chain + ".finish"


def test_script_facts():
    text = """import { A, B } from "./a"; // import "x"
export * from './all';
const q = require("r");
/** Adds. */
export function add(a: number) { const s = "function no() {}"; return inner(a); }
export interface P { a?: string; b: number }
class C {
  async run(x) { localStorage.getItem("k"); await fetch(`/api/${x}`); axios.post("/p"); useThing(); }
}
app.get("/users", h); router.use("/m", r);
describe("suite", () => { it("works", () => page.getByRole("button")) });
"""
    rows = facts("a.ts", text)
    assert names(rows, "import", "kind") == [("./a", "import"), ("./all", "export-all"), ("r", "require")]
    assert names(rows, "symbol", "kind", "exported", "owner") == [
        ("q", "const", False, ""), ("add", "function", True, ""), ("P", "interface", True, ""), ("C", "class", False, ""), ("run", "method", False, "C")]
    assert names(rows, "request", "kind", "detail", "owner") == [("/api/${x}", "GET", "dynamic", "run"), ("/p", "POST", "static", "run")]
    assert names(rows, "route", "kind") == [("/users", "GET"), ("/m", "MOUNT")]
    assert names(rows, "storage", "kind") == [("k", "localStorage")] and names(rows, "hook") == [("useThing",)]
    assert names(rows, "test", "kind") == [("suite", "describe"), ("works", "it")] and names(rows, "locator") == [("button",)]
    assert names(rows, "model_field", "kind", "owner") == [("a", "optional", "P"), ("b", "required", "P")]
    assert ("add", "Adds.") in names(rows, "doc", "detail") and ("inner", "add") in names(rows, "call", "owner")
    jsx = facts("b.tsx", "export const V = () => <Box onClick={() => go()}><b>Hello you</b></Box>;")
    assert names(jsx, "component") == [("Box",)] and names(jsx, "handler") == [("onClick",)] and names(jsx, "ui_string") == [("Hello you",)]


def test_other_languages():
    kt = facts("a.kt", "package p\nimport a.B as C\nimport d.*\ndata class K(val x: Int) {\n  private fun f() { g() }\n}\nfun top() = 1\n")
    assert names(kt, "symbol", "kind", "exported", "owner") == [("K", "class", True, ""), ("f", "method", False, "K"), ("top", "fun", True, "")]
    assert names(kt, "import", "kind") == [("a.B", "named"), ("d.*", "wildcard")]
    java = facts("A.java", "package p;\nimport static a.B;\npublic class A {\n  private int f(int x) { return g(x); }\n  interface I {}\n}\n")
    assert names(java, "symbol", "kind", "exported", "owner") == [("A", "class", True, ""), ("f", "method", False, "A"), ("I", "interface", False, "A")]
    rs = facts("a.rs", "use a::{b, c::{self, D as E}, f::*};\npub struct S;\nimpl S { pub fn m(&self) { n() } }\nmod x;\n")
    assert names(rs, "import") == [("a::b",), ("a::c::self",), ("a::c::D",), ("a::f::*",)]
    assert ("m", "method", True, "S") in names(rs, "symbol", "kind", "exported", "owner")
    xml = facts("AndroidManifest.xml", '<manifest xmlns:a="u"><application><activity a:name=".Main"/></application></manifest>')
    assert names(xml, "element", "kind") == [(".Main", "activity")] and names(facts("b.xml", "<a"), "warning") == [("not parsed",)]
    assert names(facts("Cargo.toml", '[package]\nname = "x"\n'), "setting", "detail") == [("package.name", "x")]
    assert names(facts("build.gradle", "dependencies {\n  implementation 'a:b:1'\n}"), "dependency", "kind", "line") == [("a:b:1", "implementation", 2)]


def test_extract_files(spark):
    rows = [("r", "a.py", "import x", "n"), ("r", "b.md", "import x", "n"), ("r", "c.py", None, "n"), ("r", "d.py", "", "n"), ("r", "a.py", "import x", "n")]
    df = spark.createDataFrame(rows, "repo string, path string, content string, name string")
    got = X.extract_files(df, ["repo"])
    assert got.columns == ["repo", "path", *X.FIELDS]
    assert [(r.repo, r.path, r.record, r.name) for r in got.collect()] == [("r", "a.py", "import", "x")] * 2
    assert X.extract_files(df.limit(0), ["repo"]).count() == 0


def test_stream_state_equals_batch(spark, tmp_path):
    schema = "path string, content_hash string, o int"
    src = str(tmp_path / "in")
    state = ContentState(spark, scratch(spark, "stream"), ["path"])
    run = lambda: I.keep_up(I.file_stream(spark, src, spark.createDataFrame([], schema).schema, 1), state, ["path"], "o", str(tmp_path / "cp"), "s").awaitTermination()
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], schema).coalesce(1).write.parquet(src)
    run()
    assert {tuple(r) for r in state.state().collect()} == {("a", "2"), ("b", "1")}
    version = state.manifest()["version"]
    run()  # nothing new
    assert state.manifest()["version"] == version
    spark.createDataFrame([("b", "3", 3)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {tuple(r) for r in state.state().collect()} == {("a", "2"), ("b", "3")}
    assert os.path.isdir(tmp_path / "cp")


def test_an_older_record_in_a_later_batch_does_not_win(spark, tmp_path):
    schema = "path string, content_hash string, o int"
    src = str(tmp_path / "in")
    state = ContentState(spark, scratch(spark, "stream"), ["path"])
    run = lambda: I.keep_up(I.file_stream(spark, src, spark.createDataFrame([], schema).schema, 1), state, ["path"], "o", str(tmp_path / "cp"), "s").awaitTermination()
    for rows in ([("a", "1", 1), ("b", "9", 9)], [("a", "1", 5), ("b", "8", 8)], [("a", "3", 3), ("b", None, 10)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    assert {tuple(r) for r in state.state().collect()} == {("a", "1"), ("b", None)}
    state.compact()
    spark.createDataFrame([("a", "4", 4), ("b", "7", 7)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {tuple(r) for r in state.state().collect()} == {("a", "1"), ("b", None)}


def test_event_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("u", "2025-01-01 00:00:10"), ("u", "2025-01-01 00:00:50"), ("u", "2025-01-01 00:05:00"), ("v", "2025-01-01 00:00:20"), ("v", "2025-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "u string, t string").select("u", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(src)
    for name, out in (("w", I.tumbling(I.file_stream(spark, src, df.schema), "ts", ["u"], "1 minute", "1 hour")), ("s", I.sessions(I.file_stream(spark, src, df.schema), "ts", ["u"], "2 minutes", "1 hour"))):
        q = out.writeStream.format("memory").queryName(f"win_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r.u, r.n) for r in spark.table(f"win_{name}").collect())
        assert got == [("u", 1), ("u", 2), ("v", 1)]  # the last window is still open


def test_script_bindings_and_exports():
    rows = facts("a.ts", """import d, { x as y, type T } from './m';
import * as ns from './n';
import type { U } from './t';
const { a, b: c } = require('./r'), z = 1;
export { y as out, d };
export default d;
export const f = async (p: string): Promise<{ q: number }> => { return y(p); };
export * as all from './all';
module.exports.k = c;
""")  # fmt: skip
    assert set(names(rows, "binding", "kind", "owner", "detail")) == {
        ("d", "import", "default", "./m"), ("y", "import", "x", "./m"), ("T", "type", "T", "./m"), ("ns", "import", "*", "./n"), ("U", "type", "U", "./t"),
        ("a", "require", "a", "./r"), ("c", "require", "b", "./r"),
    }
    assert set(names(rows, "export", "kind", "owner")) == {
        ("out", "alias", "y"), ("d", "alias", "d"), ("default", "default", "d"), ("f", "direct", "f"), ("all", "re-export", "*"), ("k", "commonjs", "c")}
    assert ("y", "call", "f") in names(rows, "call", "kind", "owner")
    assert ("f", "const", True) in names(rows, "symbol", "kind", "exported")
    cjs = facts("b.js", "function g() {}\nmodule.exports = { g, h: g };\n")
    assert set(names(cjs, "export", "owner")) == {("g", "g"), ("h", "g")}


def test_a_name_declared_or_written_nearby_hides_an_import():
    text = """import { f, g, h, k, m } from './x';
function one(f) { f(); g(); }
function two() { const q = () => { h(); }; h = 1; }
function three() { { let k = 2; } k(); if (a) { m(); } }
function four() { try { g() } catch (g) { } }
class C { five() { new f(); this.f(); m.deep.call(1); } }
"""
    got = {(r[1], r[6]): r[2] for r in facts("a.js", text) if r[0] == "call"}
    assert got[("f", "one")] == "shadowed" and got[("g", "one")] == "call"
    assert got[("h", "q")] == "shadowed" and got[("k", "three")] == "shadowed" and got[("m", "three")] == "call"
    assert got[("g", "four")] == "shadowed" and got[("f", "five")] == "new" and got[("<computed>.f", "five")] == "call" and ("m.deep.call", "five") in got


def test_script_syntax_that_lines_do_not_show():
    text = '''const re = /function no() {}[/]"/g, t = `function no() { ${inner(`class No {}`)} }`;
export default class extends Base<{ a: string }> {
  #p = 1; static s?: Map<string, number> = new Map();
  constructor(private readonly dep: Dep, n = () => ({ x: 1 })) { super(); }
  get v(): { a: number } { return use(1); }
  async *gen<T extends { k: string }>(this: C, ...rest: T[]): AsyncGenerator<T> { yield go(); }
  arrow = (e: Event): void => { handle(e); };
  last() {}
}
type M = { readonly [K in keyof X]: string };
type O = { a: string; b?: { c: number }[] };
type F = (a: string) => void
type U = | "a" | "b";
namespace N { export function inside() { call(); } }
enum E { A = 1 }
const load = url => fetch(url, { method: 'POST' });
function page() { load('/api/items'); }
if (a < b && c > (d)) { after(); }
'''
    rows = facts("a.ts", text)
    assert names(rows, "symbol", "kind", "owner") == [
        ("re", "const", ""), ("default", "class", ""), ("constructor", "method", "default"), ("v", "method", "default"), ("gen", "method", "default"), ("last", "method", "default"),
        ("M", "type", ""), ("O", "type", ""), ("F", "type", ""), ("U", "type", ""), ("N", "namespace", ""), ("inside", "function", "N"), ("E", "enum", ""), ("load", "const", ""), ("page", "function", "")]
    called = {(n, o) for n, o in names(rows, "call", "owner")}
    assert {("inner", ""), ("use", "v"), ("go", "gen"), ("handle", "arrow"), ("call", "inside"), ("load", "page"), ("after", "")} <= called
    assert {("M", "mapped"), ("F", "function"), ("U", "union")} == set(names(rows, "model_unsupported", "kind"))
    assert {("a", "O", "string"), ("b", "O", "{ c: number }[]"), ("s", "default", "Map<string, number>"), ("dep", "default", "Dep"), ("#p", "default", "")} <= set(names(rows, "model_field", "owner", "detail"))
    assert set(names(rows, "request", "kind", "detail")) == {("url", "POST", "dynamic"), ("/api/items", "POST", "wrapper")}
    jsx = facts("b.jsx", "export function P() { return <ul>{xs.map(x => <Li key={x} onTap={() => tap(x)}>it's {x} <b>done</b></Li>)}</ul>; }\nfunction q() { return 1 }\n")
    assert names(jsx, "symbol") == [("P",), ("q",)] and ("tap", "P") in names(jsx, "call", "owner") and set(names(jsx, "ui_string")) == {("it's",), ("done",)}


def test_jvm_and_rust_syntax():
    java = facts("A.java", """package p.q;
@Deprecated public final class A<T extends Comparable<T>> extends B implements C {
  private final Map<String, List<T>> m = make(1);
  public A(int x) { super(x); }
  @Override public <R> R run(Function<T, R> f) throws E { if (x) { return f.apply(t); } Runnable r = () -> go(); class L { void in() {} } return null; }
  enum K { ONE(1), TWO { void z() {} }; int n() { return 1; } }
  record R(int a, List<String> b) { int s() { return a(); } }
  @interface Ann { String value() default ""; }
}
""")  # fmt: skip
    assert [x[:2] + x[3:] for x in names(java, "symbol", "kind", "exported", "owner")] == [
        ("A", "class", ""), ("A", "constructor", "A"), ("run", "method", "A"), ("L", "class", "A.run"), ("in", "method", "A.run.L"), ("K", "enum", "A"), ("n", "method", "A.K"),
        ("R", "record", "A"), ("s", "method", "A.R"), ("Ann", "interface", "A"), ("value", "method", "A.Ann")] or names(java, "symbol")
    assert {("m", "A", "Map<String, List<T>>"), ("a", "R", "int"), ("b", "R", "List<String>")} <= {(n, o, d.replace("private final ", "")) for n, o, d in names(java, "model_field", "owner", "detail")}
    assert {("f.apply", "run"), ("go", "run"), ("make", "")} <= set(names(java, "call", "owner"))
    kt = facts("a.kt", """package p
/* outer /* class No */ fun no() */
sealed interface S
data class D(val a: List<Int>, var b: String = f("x")) : Base(1), S by impl {
  companion object { const val K = 1 }
  val c: Int by lazy { g() }
  fun <T> T.ext(x: Int): Map<String, T> = when (x) { 1 -> h(); else -> mapOf() }
  enum class E { A, B; fun z() = 1 }
}
fun top(block: () -> Unit) { block(); "fun no() {}" }
object O { fun m() {} }
""")  # fmt: skip
    assert names(kt, "symbol", "kind", "owner") == [
        ("S", "interface", ""), ("D", "class", ""), ("Companion", "object", "D"), ("ext", "method", "D"), ("E", "enum", "D"), ("z", "method", "D.E"), ("top", "fun", ""), ("O", "object", ""), ("m", "method", "O")]
    assert {("a", "D", "List<Int>"), ("b", "D", "String"), ("c", "D", "Int")} <= set(names(kt, "model_field", "owner", "detail"))
    assert {("g", ""), ("h", "ext"), ("block", "top"), ("f", "")} <= set(names(kt, "call", "owner"))
    rs = facts("a.rs", """#[derive(Debug)] pub struct P<T> { pub x: Vec<T>, y: [u8; 4] }
pub trait T: Base + Send { fn must(&self); fn may(&self) { self.must() } }
impl<X: Clone> T for P<X> where X: Send { fn must(&self) { crate::a::go(1); x.iter().map(|v| v + 1); } }
impl P<u8> { const Z: u8 = 1; pub async fn n<'a>(s: &'a str) -> Result<(), E> { r#"fn no() {}"#; '{'; Self::q(s) } }
enum E { A(u8), B { c: u8 } }
mod inner { pub fn deep() {} }
pub mod filed;
use a::{b as c, d::*};
macro_rules! mac { () => { fn no() {} } }
""")  # fmt: skip
    assert names(rs, "symbol", "kind", "owner") == [
        ("P", "struct", ""), ("T", "trait", ""), ("must", "method", "T"), ("may", "method", "T"), ("P", "impl", ""), ("must", "method", "P"), ("P", "impl", ""), ("Z", "const", "P"), ("n", "method", "P"),
        ("E", "enum", ""), ("inner", "module", ""), ("deep", "function", "inner"), ("filed", "module", ""), ("mac", "macro", "")]
    assert set(names(rs, "relation", "kind", "owner")) == {("T", "implements", "P"), ("Base", "supertrait", "T"), ("Send", "supertrait", "T")}
    assert names(rs, "module") == [("filed",)] and names(rs, "import", "kind", "detail") == [("a::b", "use", "c"), ("a::d::*", "wildcard", "")]
    assert ("crate::a::go", "must") in names(rs, "call", "owner") and ("Self::q", "n") in names(rs, "call", "owner")
    assert {("x", "P"), ("y", "P"), ("A", "E"), ("B", "E")} <= set(names(rs, "model_field", "owner"))


def test_lineage_of_a_script():
    text = """export interface User { name: string; age: number }
const user: User = load();
export function toView(u: User, n: number) { const x = 1; return { title: u.name, n, [k]: u.age, deep: u.a.b, years: u.age }; }
const card = ({ title, sub: s }: Props) => <div>{title}</div>;
function Card({ title, sub: s }: Props) { return <div>{title}</div>; }
export const Row = (props: P) => (<b>{props.label}{props.other.x}</b>);
const vm = { label: user.name, other: other.name };
const made = toView(user, 1);
const page = <Card title={made.title} sub={user.age} other={nothing.x}><Row label={vm.label} /></Card>;
"""
    got = {(r[2], r[1], r[6], r[7]) for r in facts("a.tsx", text) if r[0] == "lineage"}
    assert got == {
        ("alias", "User", "user", ""), ("output", "User.name", "toView", "title"), ("output", "User.age", "toView", "years"), ("unsupported", "", "toView", ""),
        ("component", "", "Card", ""), ("rendered", "title", "Card", ""), ("rendered", "sub", "Card", ""), ("component", "", "Row", ""), ("rendered", "label", "Row", ""),
        ("object", "user.name", "vm", "label"), ("object", "other.name", "vm", "other"), ("derived", "toView", "made", ""), ("used", "", "Card", ""), ("used", "", "Row", ""),
        ("pass", "made.title", "Card", "title"), ("pass", "user.age", "Card", "sub"), ("pass", "nothing.x", "Card", "other"), ("pass", "vm.label", "Row", "label"),
    }


def test_lineage_graph(spark):
    from weftline.operators import lineage

    text = """interface User { name: string; age: number }
const user: User = load();
function toView(u: User) { return { title: u.name }; }
function Card({ title }: Props) { return <b>{title}</b>; }
const made = toView(user);
const page = <Card title={made.title} years={user.age} />;
"""
    df = X.extract_files(spark.createDataFrame([("p.tsx", text), ("p.tsx", text), ("q.ts", "interface Other { name: string }\n")], "path string, content string"), [])
    nodes, edges = lineage.build(df, lineage.models_of(df))
    short = lambda s: s.replace("lineage:", "").replace("p.tsx#", "")
    assert {(r.kind, short(r.source), short(r.target)) for r in edges.collect()} == {
        ("reads-field", "data-field:User.name", "transformation:toView"), ("creates-view-model", "transformation:toView", "view-model:toView.title"),
        ("derives-field", "view-model:toView.title", "view-model:made.title"), ("passes-prop", "view-model:made.title", "component-prop:Card.title"),
        ("passes-prop", "data-field:User.age", "component-prop:Card.years"), ("renders-field", "component-prop:Card.title", "rendered-field:Card.title"),
    }
    by = {short(r.id): r for r in nodes.collect()}
    assert by["component:Card"].confidence == "explicit" and by["component-prop:Card.title"].entity == "User" and "data-field:Other.name" in by
    empty = lineage.build(df.limit(0), lineage.models_of(df.limit(0)))
    assert empty[0].count() == empty[1].count() == 0
