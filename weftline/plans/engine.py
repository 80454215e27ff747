"""An index of a source tree, end to end: build, refresh, search, lookup, slice, source, views, context and diff.

Facts come from one pass over the files; everything after it is joins over tables. Tables are published together by one
manifest. A refresh extracts changed files only and recomputes all joins, so it gives what a full build gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import bundle, calls, context, diff, exact_scan, graph, resolve, rules, text_search
from weftline.session import materialize, ship
from weftline.sources import extract, scan
from weftline.sources.artifacts import ArtifactStore

VERSION = "1"
CALLABLE = ("function", "fun", "method", "constructor")
MODEL_KINDS = ("interface", "type", "orm")


def symbol_ids(facts: DataFrame) -> DataFrame:
    """Symbols with node ids: plain for the first top-level declaration of a name in a file, else qualified with an ordinal."""
    sym = facts.filter(F.col("record") == "symbol")
    ranked = graph.ordinals(sym, "path", "owner", "name", "line", "detail")
    enc = X.encode_component
    plain = F.concat(F.lit("symbol:"), F.col("path"), F.lit("#"), F.col("name"))
    full = F.concat(F.lit("symbolq:"), enc(F.col("path")), F.lit("#"), enc(F.col("owner")), F.lit("#"), enc(F.col("name")), F.lit("#"), F.col("ordinal"))
    node = F.when((F.col("owner") == "") & (F.col("ordinal") == 0), plain).otherwise(full)
    return ranked.select("path", "name", "kind", "line", "end_line", "exported", "owner", F.col("detail").alias("signature"), node.alias("node_id"))


def python_targets(importer: Column, specifier: Column) -> Column:
    """Files a Python module name may mean, in order: relative to the importer for leading dots, else from the root."""
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.split(importer, "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - F.greatest(dots, F.lit(1)))), "/")
    base = F.when(dots > 0, F.trim(F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif(rest, F.lit(""))))).otherwise(rest)
    return F.array(F.struct(F.lit(0).alias("rank"), F.concat(base, F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("rank"), F.concat(base, F.lit("/__init__.py")).alias("path")))


def resolve_all(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(importer, specifier, kind, status, target) of all imports, by the rules of the importer's language."""
    keys = ["importer", "specifier"]
    rows = imports.select(F.col("path").alias("importer"), F.col("name").alias("specifier"), "kind").distinct()
    lang = scan.language(F.col("importer"))
    here = files.select("path").withColumn("all", F.lit(0))
    js = rows.filter(lang.isin("typescript", "javascript")).withColumn("all", F.lit(0))
    script = resolve.resolve_imports(js, here, ["all"]).drop("all")
    py = rows.filter(lang == "python").select(*keys).distinct()
    tried = py.select(*keys, F.explode(python_targets(F.col("importer"), F.col("specifier"))).alias("c")).select(*keys, "c.rank", "c.path")
    hit = tried.join(files.select("path"), "path").groupBy(*keys).agg(F.min(F.struct("rank", "path"))["path"].alias("target"))
    python = py.join(hit, keys, "left").select(*keys, F.when(F.col("target").isNull(), "external").otherwise("resolved").alias("status"), "target")
    # a class of the imported package that exactly one file declares
    jvm = rows.filter(lang.isin("kotlin", "java")).select(*keys).distinct().withColumn("name", F.substring_index("specifier", ".", -1))
    one = symbols.filter((F.col("owner") == "") & scan.language(F.col("path")).isin("kotlin", "java")).groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("t"))
    classes = jvm.join(one, "name", "left").select(
        *keys, F.when(F.col("n").isNull(), "external").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("t")).alias("target")
    )
    rest = rows.filter(lang == "rust").select(*keys, F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("target")).distinct()
    return rows.join(script.unionByName(python).unionByName(classes).unionByName(rest), keys)


def build_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): files and symbols; defines, exports, imports or depends-on, and calls to exactly one symbol."""
    node = lambda p: F.concat(F.lit("file:"), F.col(p))
    no = F.lit(None)
    nodes = files.select(
        node("path").alias("id"), F.lit("file").alias("kind"), X.basename(F.col("path")).alias("label"), "path", no.cast("string").alias("symbol_name"),
        no.cast("string").alias("symbol_kind"), "language", no.cast("int").alias("line"), no.cast("int").alias("end_line"), no.cast("boolean").alias("exported"),
    ).unionByName(symbols.select(
        F.col("node_id").alias("id"), F.lit("symbol").alias("kind"), F.col("name").alias("label"), "path", F.col("name").alias("symbol_name"),
        F.col("kind").alias("symbol_kind"), scan.language(F.col("path")).alias("language"), "line", "end_line", "exported",
    ))
    defines = symbols.select(node("path").alias("source"), F.lit("defines").alias("kind"), F.col("node_id").alias("target"))
    exports = symbols.filter("exported").select(node("path").alias("source"), F.lit("exports").alias("kind"), F.col("node_id").alias("target"))
    owned = defines.unionByName(exports).withColumn("id", graph.edge_id(F.col("source"), F.col("kind"), F.col("target")))
    dep = F.when(F.col("kind").isin("re-export", "export-all"), F.col("kind")).otherwise("import")
    deps = imports.filter((F.col("status") == "resolved") & (F.col("target") != F.col("importer")))
    files_on = graph.primary_kind(deps.select(node("importer").alias("source"), node("target").alias("target"), dep.alias("dep")))
    # a callee is what an import binding says, see calls.edges(), or a symbol of the file; in other languages than scripts
    # also what exactly one imported file declares under the name. Several matches are dropped
    able = symbols.filter(F.col("kind").isin(*CALLABLE, "const", "class"))
    met = calls.edges(facts.withColumn("repo", F.lit("")), files.select(F.lit("").alias("repo"), "path"))
    of = met.select("path", F.substring_index("caller", ".", -1).alias("caller"), "callee", "call_line", "target", "symbol", "symbol_line", "resolution")
    callee = able.groupBy(F.col("path").alias("target"), F.col("name").alias("symbol"), F.col("line").alias("symbol_line")).agg(F.count("*").alias("n"), F.min("node_id").alias("to")).filter("n = 1").drop("n")
    known = of.filter(F.col("target").isNotNull()).join(callee, ["target", "symbol", "symbol_line"]).select("path", "caller", "call_line", "to")
    open_ = of.filter(F.col("target").isNull()).select("path", "caller", "call_line", "resolution", "callee", F.regexp_extract("callee", r"([^.:]+)$", 1).alias("name"))
    own = able.filter(F.col("owner") == "").groupBy("path", "name").agg(F.count("*").alias("n"), F.min("node_id").alias("to")).filter("n = 1").drop("n")
    named = facts.filter((F.col("record") == "call") & (F.col("kind") == "local")).select("path", F.col("owner").alias("caller"), F.col("line").alias("call_line"), "name").distinct()
    here = named.join(own, ["path", "name"]).select("path", "caller", "call_line", "to")
    script = X.extension(F.col("path")).isin(*calls.SCRIPTS)
    reach = deps.select(F.col("importer").alias("path"), F.col("target").alias("at")).distinct().join(able.filter("exported").select(F.col("path").alias("at"), "name", "node_id"), "at")
    far = reach.groupBy("path", "name").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("to")).filter("n = 1").drop("n")
    there = open_.filter(~script).join(far, ["path", "name"]).select("path", "caller", "call_line", "to")
    caller = able.groupBy("path", F.col("name").alias("caller")).agg(F.count("*").alias("m"), F.min("node_id").alias("source")).filter("m = 1").drop("m")
    every = known.unionByName(here).unionByName(there)
    called = every.join(caller, ["path", "caller"]).select("source", F.lit("calls").alias("kind"), F.col("to").alias("target"), F.col("call_line").alias("line")).distinct()
    called = called.withColumn("id", graph.edge_id(F.col("source"), F.col("kind"), F.col("target"), F.col("line"))).drop("line")
    edges = owned.unionByName(files_on).unionByName(called)
    return nodes, rules.first_of(edges, ["id"], ["kind"])


class CodeIndex:
    """The tables of one source tree in a folder shared by all executors."""

    TABLES = ("files", "facts", "symbols", "imports", "nodes", "edges")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, ArtifactStore(spark, path)
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in CodeIndex.TABLES:
            return self.store.read(name, [VERSION])
        raise AttributeError(name)

    # building
    def _ledger(self, root: str, excludes: Sequence[str]) -> DataFrame:
        return materialize(self.spark, scan.scan(self.spark, root, excludes), "ledger")

    def _publish(self, led: DataFrame, facts: DataFrame) -> None:
        files = led.filter(F.col("status") == "supported").select(
            F.col("rel_path").alias("path"), "language", "size_bytes", "content_sha256", F.size(X.lines(F.col("text"))).alias("line_count"), F.col("text").alias("content")
        )
        facts = materialize(self.spark, facts, "facts")
        symbols = materialize(self.spark, symbol_ids(facts), "symbols")
        imports = materialize(self.spark, resolve_all(facts.filter(F.col("record") == "import"), files, symbols), "imports")
        nodes, edges = build_graph(files, symbols, imports, facts)
        tables = dict(zip(self.TABLES, (files, facts, symbols, imports, nodes, edges)))
        self.store.publish({k: (v, VERSION) for k, v in tables.items()})

    def build(self, root: str, excludes: Sequence[str] = ()) -> "CodeIndex":
        """Index all files under a root."""
        led = self._ledger(root, excludes)
        supported = led.filter(F.col("status") == "supported")
        self._publish(led, extract.extract_files(supported, [], "rel_path", "text"))
        return self

    def build_from(self, files: DataFrame) -> "CodeIndex":
        """Index files that are rows: (rel_path, content as bytes, size_bytes)."""
        led = materialize(self.spark, scan.ledger(files), "ledger")
        self._publish(led, extract.extract_files(led.filter(F.col("status") == "supported"), [], "rel_path", "text"))
        return self

    def refresh(self, root: str, excludes: Sequence[str] = ()) -> DataFrame:
        """Index again, extracting only files whose content changed. Gives (path, class) of what differs."""
        led = self._ledger(root, excludes)
        now = led.filter(F.col("status") == "supported").select(F.col("rel_path").alias("path"), "content_sha256")
        classes = diff.change_classes(self.files.select("path", "content_sha256"), now, "path", "content_sha256")
        changed = materialize(self.spark, classes.filter(F.col("class") != "unchanged"), "changed")
        if changed.isEmpty():
            return changed
        fresh = led.filter(F.col("status") == "supported").join(changed.withColumnRenamed("path", "rel_path"), "rel_path", "left_semi")
        kept = self.facts.join(changed, "path", "left_anti")
        self._publish(led, kept.unionByName(extract.extract_files(fresh, [], "rel_path", "text")))
        return changed

    # queries
    def candidates(self) -> DataFrame:
        """The searchable fields of nodes, files and edges."""
        n, i = self.nodes, self.imports
        cells = {"nodeId": F.col("id"), "label": F.col("label"), "path": F.col("path"), "symbolName": F.col("symbol_name"), "symbolKind": F.col("symbol_kind"), "export": F.when(F.col("exported"), F.col("symbol_name"))}
        out = text_search.fields(n.filter("kind = 'symbol'"), "symbol", F.col("id"), cells, F.col("path"))
        out = out.unionByName(text_search.fields(n.filter("kind = 'file'"), "file", F.col("id"), {"nodeId": F.col("id"), "label": F.col("label"), "path": F.col("path")}, F.col("path")))
        at = F.concat(F.lit("file:"), F.col("importer"))
        out = out.unionByName(text_search.fields(i, "file", at, {"import": F.col("specifier"), "neighbor": F.col("target"), "edgeKind": F.col("kind")}, F.col("importer")))
        e = self.edges
        return out.unionByName(text_search.fields(e, "edge", F.col("id"), {"edgeKind": F.col("kind"), "nodeId": F.col("id"), "neighbor": F.concat_ws(" ", "source", "target")}))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """(kind, id, path, score, matched_terms), best first; 1 to 100 rows."""
        if not 1 <= limit <= 100:
            raise ValueError("the limit is 1 to 100")
        found = text_search.relevance(text_search.scoped(self.candidates(), query), query)
        return text_search.ranked(found, limit).drop("reasons")

    def lookup(self, node: str, depth: int = 1) -> dict[str, DataFrame]:
        return graph.lookup(self.spark, self.nodes, self.edges, node, depth)

    def slice(self, node: str, depth: int = 1, direction: str = "both", kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) round a node: the reached nodes and the edges among them."""
        seed = self.nodes.filter(F.col("id") == node).select("id")
        ids = materialize(self.spark, graph.slice_graph(self.spark, self.edges, seed, depth, direction, kinds), "slice")
        return self.nodes.join(ids, "id", "left_semi"), graph.induced(self.edges, ids)

    def source(self, node: str) -> DataFrame:
        """(path, start_line, end_line, complete, slice) of a node: its declaration, or the file; a preview where its end is unknown."""
        n = self.nodes.filter(F.col("id") == node).select("path", F.coalesce("line", F.lit(1)).alias("start_line"), "end_line", "kind")
        got = n.join(self.files.select("path", "content", "line_count"), "path")
        end = F.when(F.col("kind") == "file", F.col("line_count")).otherwise(F.coalesce("end_line", F.least("line_count", F.col("start_line") + (bundle.PREVIEW_LINES - 1))))
        known = (F.col("kind") == "file") | F.col("end_line").isNotNull()
        return got.select("path", "start_line", end.alias("end_line"), known.alias("complete"), bundle.block_text(F.col("content"), F.col("start_line"), end).alias("slice"))

    def bundles(self) -> DataFrame:
        top = self.symbols.filter(F.col("owner") == "").select("path", "name", "line", "end_line")
        return bundle.bundles(top, self.files.select("path", "content"), ["path"])

    def exact(self, needle: str, prefix: str = "") -> DataFrame:
        """Literal matches in files under a path prefix, with their kind, capped, with the total."""
        files = self.files.filter(F.col("path").startswith(prefix)).select("path", "content")
        found = exact_scan.capped(exact_scan.matches(files, "path", "content", needle), "path")
        return found.withColumn("match_kind", exact_scan.match_kind(F.col("line_text"), F.col("column")))

    def classify(self) -> DataFrame:
        """(path, role, confidence, conflict, guidance) of files; files without a rule have one row of nulls."""
        v = self.files.select("path", rules.resolve(rules.file_rules(F.col("path"), F.col("content"))).alias("v"))
        return v.select("path", F.explode_outer("v.classes").alias("c"), "v.conflict", rules.guidance(F.col("v.classes")).alias("guidance")).select("path", "c.role", "c.confidence", "conflict", "guidance")

    def data_model(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(entities, fields, relations): models, their fields, and fields whose type names exactly one other model."""
        f = self.facts
        ent = f.filter((F.col("record") == "model") & F.col("kind").isin(*MODEL_KINDS)).select(F.concat(F.lit("data-model-entity:"), "name").alias("id"), "name", "kind", "path").distinct()
        fld = f.filter(F.col("record") == "model_field").select(F.concat(F.lit("data-model-field:"), "owner", F.lit("."), "name").alias("id"), F.col("owner").alias("entity"), F.col("name").alias("field"), F.col("detail").alias("type"), (F.col("kind") == "optional").alias("optional"), "path").distinct()
        one = ent.groupBy("name").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("name").alias("to"))
        named = fld.select("entity", "field", "type", F.explode(F.array_distinct(F.regexp_extract_all("type", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("to"))
        many = F.col("type").rlike(r"\[\]|\b(List|Set|Array|ReadonlyArray|Collection)\b|ManyToMany")
        rel = named.join(one, "to").filter(F.col("to") != F.col("entity")).select("entity", "field", "to", F.when(many, "many").otherwise("one").alias("cardinality"))
        return ent, fld, rel

    def view(self, kind: str) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, kind, label) and edges (source, target, kind) to draw: files, symbols or models."""
        if kind == "files":
            n, e = self.nodes.filter("kind = 'file'"), self.edges.filter(F.col("kind").isin("imports", "depends-on"))
        elif kind == "symbols":
            n, e = graph.view(self.nodes, self.edges.filter(F.col("kind").isin("calls", "defines")), ["symbol"])
        elif kind == "data-model":
            ent, _, rel = self.data_model()
            node = lambda c: F.concat(F.lit("data-model-entity:"), F.col(c))
            return ent.select("id", F.lit("data-model-entity").alias("kind"), F.col("name").alias("label")), rel.select(node("entity").alias("source"), node("to").alias("target"), F.lit("relates-to").alias("kind"))
        else:
            raise ValueError(kind)
        return n.select("id", "kind", "label"), e.select("source", "target", "kind")

    def context(self, task: str, role: str = "none", focus: str | None = None) -> DataFrame:
        """Evidence for a task: ranked files with their boosts, the best ones with a bounded slice and a continuation.

        (rank, path, score, end_line, truncated, next_line, slice).
        """
        found = text_search.relevance(self.candidates(), X.without_connectors(task)).filter(F.col("path").isNotNull())
        per = found.groupBy("path").agg(F.max("score").alias("base"), F.max("matched_terms").alias("terms"))
        flags = {"focus_file": F.lit(False) if focus is None else F.col("path") == focus, "owner_like": X.basename(F.col("path")).rlike(context.OWNER_LIKE), "contract_like": X.basename(F.col("path")).rlike(context.CONTRACT_LIKE), "closest_test": X.is_test_path(F.col("path"))}
        score = context.adjusted(F.col("path"), F.col("base"), F.col("terms"), "", F.lit(""), F.lit("")) + context.boost(role, flags)
        top = per.select("path", score.alias("score")).orderBy(F.desc("score"), "path").limit(bundle.SLICES)
        ranked = top.select(F.col("path").alias("id"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "path")).alias("rank"))  # at most SLICES rows
        docs = self.files.select(F.col("path").alias("key"), "content", "path")
        return bundle.capsule(ranked, docs, "key", "content", "path").drop("key")

    def diff(self, after: "CodeIndex") -> tuple[DataFrame, DataFrame]:
        """(node changes, edge changes) from this index to a later one."""
        fields = ["kind", "label", "path", "symbol_name", "symbol_kind", "language", "line", "end_line", "exported"]
        return diff.keyed_diff(self.nodes, after.nodes, "id", fields), diff.keyed_diff(self.edges, after.edges, "id", ["source", "kind", "target"])
