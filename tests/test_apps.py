from pyspark.sql import functions as F

from weftline.functions.text import is_test_path
from weftline.operators import android as A
from weftline.operators import reachability as R
from weftline.plans.engine import symbol_ids
from weftline.sources import extract


def facts_of(spark, tree):
    files = spark.createDataFrame(list(tree.items()), "path string, content string")
    return files, extract.extract_files(files, [])


def got(df, *cols):
    return sorted((tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols).collect()), key=str)


WEB = {
    "src/Home.tsx": 'app.get("/Home", Home);\nexport function Home() {\n  localStorage.getItem("seen");\n  return <Box><p>Hello  you</p></Box>;\n}\n',
    "src/Other.tsx": 'app.get("/home", X);\nrouter.get("/users/:id", Y);\nexport function Other() { return <p>Bye</p>; }\n',
    "tests/home.spec.ts": 'import { test as t } from "runner";\ntest("greets", () => page.getByText("Hello  you"));\n',
}


def test_reachability(spark):
    files, facts = facts_of(spark, WEB)
    f = R.reach_facts(facts).cache()
    by = {r.id: r for r in f.collect()}
    assert by["route:/home"].files == ["src/Home.tsx", "src/Other.tsx"] and by["route:/home"].confidence == "high"
    assert by["route:/users/:id"].confidence == "low" and "ui:text:hello-you" in by and "storage:localStorage:seen" in by
    comp = facts.filter((F.col("record") == "symbol") & F.col("path").endswith("x")).select(F.col("name").alias("component"), "path")
    e = R.reach_edges(f, comp)
    kinds = set(got(e, "source", "kind", "target"))
    assert ("route:/home", "route-renders-component", "component:Home") in kinds and ("component:Home", "component-shows-ui", "ui:text:hello-you") in kinds
    assert ("storage:localStorage:seen", "storage-gates-ui", "ui:text:hello-you") in kinds
    assert ("ui:test:greets", "test-covers-ui", "ui:text:hello-you") in kinds
    assert got(R.find(f, "route", "HOME"), "id") == ["route:/home"] and got(R.find(f, "ui", "hello", exact=True), "id") == []
    assert len(got(R.related(e, R.find(f, "storage", "seen")), "id")) == 1
    cut = R.reach_slice(spark, e, R.find(f, "storage", "seen", exact=True), "storage")
    assert ("component:Home", "ui:text:hello-you") in got(cut, "source", "target")
    src = R.reach_source(facts.filter("record = 'storage'").select(F.col("name").alias("id"), "path", "line"), files).first()
    assert (src.from_line, src.to_line) == (1, 5)
    assert R.react_region(facts, "home").first().record == "symbol" and R.react_region(facts, "nothing").count() == 0
    assert got(R.test_infrastructure(facts, is_test_path(F.col("path"))), "specifier", "files") == [("runner", 1)]
    assert R.reach_facts(facts.limit(0)).count() == 0


APP = {
    "app/src/main/AndroidManifest.xml": '<manifest xmlns:a="u" package="x.app"><uses-permission a:name="net"/><uses-permission a:name="own"/><permission a:name="own"/>'
    '<application><activity a:name=".Main"/><service a:name="x.other.Sync"/><activity a:name="Gone"/></application></manifest>',
    "app/src/main/java/Main.kt": 'package x.app\nclass Main {\n  val a = R.string.title\n  val b = android.R.string.ok\n}\nfun later() { R.layout.page }\n',
    "app/src/main/java/Sync.kt": "package x.other\nclass Sync\n",
    "app/src/main/java/UserViewModel.kt": "package x.app\nimport x.data.UserRepository\nclass UserViewModel(private val repo: UserRepository, val other: LocalRepository, val n: Int) {\n}\n",
    "app/src/main/java/UserRepository.kt": "package x.data\nclass UserRepository(val dao: UserDao) {\n}\n", "b/UserRepository.kt": "package x.app\nclass UserRepository\n",
    "a/LocalRepository.kt": "package p.a\nclass LocalRepository\n", "b/LocalRepository.kt": "package p.b\nclass LocalRepository\n",
    "app/src/main/res/values/strings.xml": '<resources><string name="title">T</string></resources>', "app/src/main/res/values-de/strings.xml": '<resources><string name="title">U</string></resources>',
    "app/src/main/res/layout/page.xml": "<LinearLayout/>",
    "app/src/main/res/navigation/nav.xml": '<navigation xmlns:a="u"><fragment a:id="@+id/home"><action a:id="@+id/go" a:destination="@id/detail"/><action a:id="@+id/lost" a:destination="@id/none"/></fragment><fragment a:id="@+id/detail"/></navigation>',
}


def test_android(spark):
    files, facts = facts_of(spark, APP)
    symbols = symbol_ids(facts)
    elements = facts.filter("record = 'element'")
    classes = A.class_names(symbols, files)
    assert ("x.app.Main", "symbol:app/src/main/java/Main.kt#Main") in got(classes, "fqcn", "node_id")
    manifest = spark.createDataFrame([("app/src/main/AndroidManifest.xml", "x.app")], "path string, package string")
    m = A.manifest_edges(elements, manifest, classes)
    assert len(got(m.filter("kind = 'manifest-declares-component'"), "id")) == 3
    assert {t.split("#")[-1] for t in got(m.filter("kind = 'manifest-component-resolves-to-source'"), "target")} == {"Main", "Sync"}
    assert got(A.permission_edges(elements), "target") == ["android-permission-reference:net", "android-permission:own"]
    res = A.resources(elements, files)
    refs = A.resource_references(files, symbols, res)
    assert got(refs, "source", "candidate", "target") == [
        ("symbol:app/src/main/java/Main.kt#Main", True, "android-resource:app/src/main/res/values-de/strings.xml#string/title"),
        ("symbol:app/src/main/java/Main.kt#Main", True, "android-resource:app/src/main/res/values/strings.xml#string/title"),
        ("symbol:app/src/main/java/Main.kt#later", False, "android-resource:app/src/main/res/layout/page.xml#layout/page"),
    ] and all(i.endswith(("@3", "@6")) for i in got(refs, "id"))
    nav = {(s.split("#")[-1], k.split("-", 1)[1], t.split("#")[-1]) for s, k, t in got(A.navigation_edges(elements), "source", "kind", "target")}
    assert ("go", "action-targets-destination", "detail") in nav and ("home", "destination-has-action", "lost") in nav and not any(s == "lost" for s, _, _ in nav)
    deps = got(A.dependency_edges(classes, facts.filter("record = 'import'"), files), "kind", "target", "candidate")
    assert deps == [
        ("viewmodel-uses-repository", "symbol:a/LocalRepository.kt#LocalRepository", True), ("viewmodel-uses-repository", "symbol:app/src/main/java/UserRepository.kt#UserRepository", False),
        ("viewmodel-uses-repository", "symbol:b/LocalRepository.kt#LocalRepository", True)]
