import pytest
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.engine import CodeIndex
from weftline.session import scratch

TREE = {
    "src/app.ts": 'import { load } from "./store/loader.js";\nexport * from "./types";\n\nexport function run(id: string) {\n  const user = load(id);\n  return render(user);\n}\n\nfunction render(u: User) { return u.name; }\n',
    "src/store/loader.ts": 'import type { User } from "../types";\nexport function load(id: string): User { return fetchUser(id); }\nfunction fetchUser(id: string) { return null; }\n',
    "src/types.ts": "export interface User { name: string; roles?: Role[]; }\nexport interface Role { key: string }\n",
    "py/main.py": "from .util import helper\nimport os\n\ndef go():\n    return helper(1)\n",
    "py/util.py": "def helper(x):\n    return x\n",
    "k/A.kt": "package k\nimport k.B\nclass A { fun f() { g() } }\n", "k/B.kt": "package k\nclass B\n",
    "node_modules/x.js": "function no() {}\n", "README.md": "# loader\n",
}


def write(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    return root, CodeIndex(spark, scratch(spark, "index")).build(str(root))


def col(df, *cols):
    return sorted((tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols).collect()), key=str)


def test_tables(built):
    _, ix = built
    assert col(ix.files, "path") == ["k/A.kt", "k/B.kt", "py/main.py", "py/util.py", "src/app.ts", "src/store/loader.ts", "src/types.ts"]
    got = {(r.importer, r.specifier): (r.status, r.target) for r in ix.imports.collect()}
    assert got[("src/app.ts", "./store/loader.js")] == ("resolved", "src/store/loader.ts")
    assert got[("src/store/loader.ts", "../types")] == ("resolved", "src/types.ts")
    assert got[("py/main.py", ".util")] == ("resolved", "py/util.py") and got[("py/main.py", "os")] == ("external", None)
    assert got[("k/A.kt", "k.B")] == ("resolved", "k/B.kt")
    edges = set(col(ix.edges, "id"))
    assert {"file:src/app.ts--imports-->file:src/store/loader.ts", "file:src/app.ts--depends-on-->file:src/types.ts", "symbol:src/app.ts#run--calls-->symbol:src/store/loader.ts#load@5",
            "symbol:src/app.ts#run--calls-->symbol:src/app.ts#render@6", "symbol:py/main.py#go--calls-->symbol:py/util.py#helper@5"} <= edges
    assert graph.checked(ix.nodes, ix.edges).count() == 0


def test_queries(built):
    _, ix = built
    best = ix.search("load", 5).collect()
    assert best[0].id == "symbol:src/store/loader.ts#load"
    assert ix.search("symbol:src/app.ts#run").count() == 1
    with pytest.raises(ValueError):
        ix.search("x", 101)
    near = ix.lookup("symbol:src/app.ts#run", 1)
    assert "symbol:src/store/loader.ts#load" in col(near["neighbours"], "id")
    nodes, edges = ix.slice("file:src/app.ts", 1, "outgoing", ["imports", "depends-on"])
    assert {"file:src/types.ts", "file:src/store/loader.ts"} <= set(col(nodes, "id")) and edges.count() >= 4
    src = ix.source("symbol:src/app.ts#run").first()
    assert (src.start_line, src.end_line, src.complete) == (4, 7, True) and src.slice.startswith("export function run")
    assert ix.source("file:py/util.py").first().end_line == 2
    hits = ix.exact("load", "src/").collect()
    assert {(h.path, h.line) for h in hits} >= {("src/app.ts", 1), ("src/app.ts", 5), ("src/store/loader.ts", 2)} and not hits[0].truncated
    assert ("run", "render") in col(ix.bundles().filter("path = 'src/app.ts'"), "primary", "name")
    assert col(ix.classify().filter("path = 'src/types.ts'"), "guidance") == ["uncertain"]


def test_models_views_context(built):
    _, ix = built
    ent, fld, rel = ix.data_model()
    assert col(ent, "name") == ["Role", "User"] and col(rel, "entity", "field", "to", "cardinality") == [("User", "roles", "Role", "many")]
    assert ("User", "roles", True) in col(fld, "entity", "field", "optional")
    n, e = ix.view("data-model")
    assert n.count() == 2 and e.count() == 1
    n, e = ix.view("files")
    assert n.count() == 7 and ("file:py/main.py", "file:py/util.py") in col(e, "source", "target")
    assert ix.view("symbols")[0].count() > 5
    with pytest.raises(ValueError):
        ix.view("other")
    got = ix.context("how to load a user", "implementation", "src/types.ts").orderBy("rank").collect()
    assert got[0].path == "src/types.ts" and got[0].score > got[1].score and not got[0].truncated


def test_refresh_equals_full_build(spark, tmp_path):
    root = tmp_path / "t"
    write(root, TREE)
    ix = CodeIndex(spark, scratch(spark, "index")).build(str(root))
    before = CodeIndex(spark, ix.store.path)
    held = {t: getattr(before, t) for t in ("nodes", "edges")}
    assert ix.refresh(str(root)).isEmpty()
    # the target of an unchanged file's import goes away, another appears, one file changes
    (root / "src/types.ts").unlink()
    write(root, {"src/types/index.ts": "export interface User { name: string }\n", "py/util.py": "def helper(x, y):\n    return x\n\ndef extra(): pass\n"})
    assert {tuple(r) for r in ix.refresh(str(root)).collect()} == {("src/types.ts", "removed"), ("src/types/index.ts", "added"), ("py/util.py", "changed")}
    full = CodeIndex(spark, scratch(spark, "index")).build(str(root))
    for t in CodeIndex.TABLES:
        cols = sorted(getattr(full, t).columns)
        assert col(getattr(ix, t), *cols) == col(getattr(full, t), *cols), t
    assert ix.imports.filter((F.col("importer") == "src/app.ts") & (F.col("specifier") == "./types")).first().target == "src/types/index.ts"
    from weftline.operators.diff import keyed_diff

    got = {r.id: r.change for r in keyed_diff(held["nodes"], ix.nodes, "id", ["kind", "label", "line"]).collect()}
    assert got["file:src/types.ts"] == "removed" and got["symbol:py/util.py#extra"] == "added"
    assert ix.diff(full)[0].count() == 0 and ix.diff(full)[1].count() == 0
