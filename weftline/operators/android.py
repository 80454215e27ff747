"""Android projects as graph edges: manifests, resources, navigation, components and their dependencies.

Works on extracted facts: XML elements (`element`), symbols and imports, and on the files' texts. Every candidate of an
ambiguous name becomes its own edge, marked as such; nothing is picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import basename
from weftline.operators.graph import edge_id

# fixed values: component elements of a manifest, and what depends on what by the roles of class names
COMPONENTS = ("activity", "activity-alias", "service", "receiver", "provider")
DEPENDENCIES = (
    ("ViewModel", "Repository", "viewmodel-uses-repository"), ("Repository", "Dao", "repository-uses-dao"),
    ("Repository", "Service", "repository-uses-service"), ("Dao", "Entity", "dao-uses-entity"), ("Database", "Dao", "room-database-exposes-dao"),
)


def with_candidates(pairs: DataFrame, kind: Column | str) -> DataFrame:
    """(id, source, target, kind, candidate) of (source, target): candidate where the source has several targets."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    n = F.count("*").over(Window.partitionBy("source", "kind"))
    rows = pairs.select("source", "target", k.alias("kind")).distinct()
    return rows.withColumn("candidate", n > 1).withColumn("id", edge_id(F.col("source"), F.col("kind"), F.col("target")))


def class_names(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(fqcn, simple, node_id, path) of Kotlin and Java classes: package and name."""
    package = files.filter(F.col("path").rlike(r"\.(kt|java)$")).select("path", F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)", 1).alias("package"))
    top = symbols.filter((F.col("owner") == "") & F.col("kind").isin("class", "interface", "object", "enum"))
    return top.join(package, "path").select(F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")).alias("fqcn"), F.col("name").alias("simple"), "node_id", "path", "package")


def manifest_edges(elements: DataFrame, packages: DataFrame, classes: DataFrame) -> DataFrame:
    """Manifests to their components, and components to the classes they name.

    `elements` are facts of AndroidManifest.xml files; `packages` has path and package of each manifest. A name that
    begins with a dot, or has none, is in the manifest's package.
    """
    comp = elements.filter(F.col("kind").isin(*COMPONENTS)).select("path", "kind", "name")
    full = F.when(F.col("name").startswith("."), F.concat("package", "name")).when(F.instr("name", ".") == 0, F.concat_ws(".", "package", "name")).otherwise(F.col("name"))
    named = comp.join(packages, "path").withColumn("fqcn", full).withColumn("component", F.concat(F.lit("android-component:"), "path", F.lit("#"), "fqcn"))
    declares = with_candidates(named.select(F.concat(F.lit("file:"), "path").alias("source"), F.col("component").alias("target")), "manifest-declares-component").withColumn("candidate", F.lit(False))
    resolves = with_candidates(named.join(classes.select("fqcn", "node_id"), "fqcn").select(F.col("component").alias("source"), F.col("node_id").alias("target")), "manifest-component-resolves-to-source")
    return declares.unionByName(resolves)


def permission_edges(elements: DataFrame) -> DataFrame:
    """Manifests to the permissions they use; one that no manifest declares is a reference node, so it still has an edge."""
    uses = elements.filter(F.col("kind").isin("uses-permission", "uses-permission-sdk-23"))
    declared = elements.filter(F.col("kind") == "permission").select("name", F.lit(True).alias("declared")).distinct()
    rows = uses.select(F.concat(F.lit("file:"), "path").alias("source"), "name").distinct().join(declared, "name", "left")
    target = F.concat(F.when(F.col("declared"), F.lit("android-permission:")).otherwise(F.lit("android-permission-reference:")), "name")
    return with_candidates(rows.select("source", target.alias("target")), "manifest-uses-permission").withColumn("candidate", F.lit(False))


def resources(elements: DataFrame, files: DataFrame) -> DataFrame:
    """(key, node_id, path): resources as type/name, from values files and from file names under res/."""
    values = elements.filter(F.col("path").rlike(r"(^|/)res/values[^/]*/")).filter(~F.col("kind").isin("item", "resources"))
    a = values.select(F.concat_ws("/", F.when(F.col("kind").rlike("-array$"), "array").otherwise(F.col("kind")), "name").alias("key"), "path")
    b = files.filter(F.col("path").rlike(r"(^|/)res/(?!values)[a-z]+[^/]*/[^/]+$")).select(
        F.concat_ws("/", F.regexp_extract("path", r"(?:^|/)res/([a-z]+)[^/]*/[^/]+$", 1), F.regexp_replace(basename(F.col("path")), r"\..*$", "")).alias("key"), "path"
    )
    return a.unionByName(b).distinct().withColumn("node_id", F.concat(F.lit("android-resource:"), "path", F.lit("#"), "key"))


def resource_references(files: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Edges from the enclosing top-level symbol, or the file, to the resources that `R.type.name` names; `@line` in the id.

    `files` hold code whose comments and strings are blank. References through `android.R` are left out. The enclosing
    symbol is the last one that begins at or before the line.
    """
    code = files.filter(F.col("path").rlike(r"\.(kt|java)$")).select("path", F.posexplode(F.split("content", "\n")).alias("i", "l"))
    refs = code.filter(F.col("l").contains("R.")).select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(r"((?:android\.)?\bR\.[a-z]+\.\w+)"), F.lit(1))).alias("r"))
    own = refs.filter(~F.col("r").startswith("android.")).withColumn("key", F.replace(F.regexp_replace("r", r"^R\.", ""), F.lit("."), F.lit("/"))).distinct()
    top = symbols.filter(F.col("owner") == "").select("path", F.struct("line", "node_id").alias("s"))
    held = own.join(top.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("all")), "path", "left")
    before = F.filter(F.coalesce("all", F.array().cast("array<struct<line:int,node_id:string>>")), lambda s: s["line"] <= F.col("line"))
    source = F.coalesce(F.try_element_at(before, F.lit(-1))["node_id"], F.concat(F.lit("file:"), "path"))
    pairs = held.select(source.alias("source"), "key", "line").join(found.select("key", F.col("node_id").alias("target")), "key")
    many = found.groupBy("key").agg((F.count("*") > 1).alias("candidate"))
    rows = pairs.join(many, "key").select("source", "target", F.lit("source-references-resource").alias("kind"), "candidate", "line").distinct()
    return rows.withColumn("id", F.concat(edge_id(F.col("source"), F.col("kind"), F.col("target")), F.lit("@"), F.col("line"))).drop("line")


def navigation_edges(elements: DataFrame) -> DataFrame:
    """Graphs to destinations, destinations to their actions, actions to the destination whose id they name."""
    nav = elements.filter(F.col("path").rlike(r"(^|/)res/navigation/")).withColumn("key", F.regexp_replace("name", r"^@\+?id/", ""))
    node = lambda c: F.concat(F.lit("android-navigation:"), F.col("path"), F.lit("#"), F.col(c))
    dest = nav.filter(F.col("kind").isin("fragment", "activity", "dialog", "composable"))
    act = nav.filter(F.col("kind") == "action").withColumn("holder", F.regexp_replace("owner", r"^@\+?id/", "")).withColumn("to", F.regexp_replace("detail", r"^@\+?id/", ""))
    a = with_candidates(dest.select(F.concat(F.lit("file:"), "path").alias("source"), node("key").alias("target")), "navigation-graph-contains-destination").withColumn("candidate", F.lit(False))
    b = with_candidates(act.select(node("holder").alias("source"), node("key").alias("target")), "navigation-destination-has-action").withColumn("candidate", F.lit(False))
    hit = act.select("path", "key", "to").join(dest.select("path", F.col("key").alias("to")), ["path", "to"])
    c = with_candidates(hit.select(node("key").alias("source"), node("to").alias("target")), "navigation-action-targets-destination")
    return a.unionByName(b).unionByName(c)


def dependency_edges(classes: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """What classes take in their constructors, by the roles of their names, resolved by tiers.

    A type is looked for among the file's imports, then in its package, then by its simple name; only the best tier that
    has an answer counts. One answer is an edge, several are candidate edges, none is no edge.
    """
    src = classes.join(files.select("path", "content"), "path")
    header = F.regexp_extract("content", r"(?s)(?:class|interface)\s+\w+\s*(?:@\w+\s*)?(?:constructor\s*)?\(([^{]*?)\)\s*[:{\n]", 1)
    body = F.concat_ws(" ", header, F.array_join(F.regexp_extract_all("content", F.lit(r"abstract\s+fun\s+\w+\(\)\s*:\s*(\w+)"), F.lit(1)), " "))
    used = src.select(F.col("node_id").alias("source"), F.col("simple").alias("user"), "path", "package", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b([A-Z]\w*)\b"), F.lit(1)))).alias("type"))
    kind = F.lit(None).cast("string")
    for a, b, name in reversed(DEPENDENCIES):
        kind = F.when(F.col("user").endswith(a) & F.col("type").endswith(b), name).otherwise(kind)
    want = used.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.col("type") != F.col("user")))
    full = imports.select("path", F.col("name").alias("fqcn"), F.substring_index("name", ".", -1).alias("type")).distinct()
    to = classes.select("fqcn", F.col("simple").alias("type"), F.col("node_id").alias("target"), F.col("package"))
    base = want.select("source", "kind", "path", "package", "type")
    tier0 = base.join(full, ["path", "type"]).join(to.select("fqcn", "target"), "fqcn").select("source", "kind", "type", "target", F.lit(0).alias("tier"))
    tier1 = base.join(to.select("package", "type", "target"), ["package", "type"]).select("source", "kind", "type", "target", F.lit(1).alias("tier"))
    tier2 = base.join(to.select("type", "target"), "type").select("source", "kind", "type", "target", F.lit(2).alias("tier"))
    every = tier0.unionByName(tier1).unionByName(tier2).distinct()
    w = Window.partitionBy("source", "kind", "type")
    best = every.withColumn("best", F.min("tier").over(w)).filter("tier = best").withColumn("candidate", F.count("*").over(w) > 1)
    return best.select("source", "target", "kind", "candidate").distinct().withColumn("id", edge_id(F.col("source"), F.col("kind"), F.col("target")))


def gradle_edges(facts: DataFrame) -> DataFrame:
    """(source, target, kind, status): settings files to the modules they include, modules to what they depend on.

    `facts` are those of Gradle files: `dependency` with kind include, project or a configuration. A module is named by
    the folder of its settings file and its path; the nearest settings file above a build file is that of its project.
    """
    dep = facts.filter(F.col("record") == "dependency").select("path", "name", "kind").distinct()
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    included = dep.filter("kind = 'include'").select(folder.alias("root"), "path", F.regexp_replace("name", "^:", "").alias("module"))
    node = lambda root, module: F.concat(F.lit("gradle-module:"), root, F.lit(":"), module)
    a = included.select(F.concat(F.lit("file:"), "path").alias("source"), node(F.col("root"), F.col("module")).alias("target"), F.lit("project-includes-module").alias("kind"), F.lit("resolved").alias("status"))
    # a build file's own folder and those above it, each a candidate for the project's root
    parts = F.split(folder, "/")
    build = dep.filter("kind <> 'include' and kind <> 'id'").withColumn("_p", parts)
    above = build.select("path", "name", "kind", F.explode(F.sequence(F.lit(0), F.size("_p"))).alias("n"), "_p")
    tried = above.select("path", "name", "kind", F.array_join(F.slice("_p", 1, F.col("n")), "/").alias("root"), F.array_join(F.slice("_p", F.col("n") + 1, F.size("_p")), ":").alias("module"))
    roots = included.select("root").distinct()
    near = tried.join(roots, "root").groupBy("path", "name", "kind").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("r")).select("name", "kind", "r.*")
    known = included.select("root", F.col("module").alias("to"), F.lit(True).alias("there")).distinct()
    own = near.filter("kind = 'project'").withColumn("to", F.regexp_replace("name", "^:", "")).join(known, ["root", "to"], "left")
    b = own.select(node(F.col("root"), F.col("module")).alias("source"), node(F.col("root"), F.col("to")).alias("target"), F.lit("module-depends-on-module").alias("kind"), F.when(F.col("there"), "resolved").otherwise("unresolved").alias("status"))
    c = near.filter("kind <> 'project'").select(node(F.col("root"), F.col("module")).alias("source"), F.concat(F.lit("gradle-artifact:"), "name").alias("target"), F.lit("module-depends-on-artifact").alias("kind"), F.lit("external").alias("status"))
    return a.unionByName(b).unionByName(c).distinct()
