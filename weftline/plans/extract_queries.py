"""Facts extracted from source files and the joins over them, with oracle SQL where SQL can read the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import bundle as B
from weftline.operators import calls
from weftline.operators import graph as G
from weftline.operators import resolve as V
from weftline.operators import rust
from weftline.sources import extract, scan
from weftline.session import materialize, scratch, ship, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "repo", "file_no", "path", "content")


def _numbered(spark: SparkSession, d: str, *records: str) -> DataFrame:
    """Facts of the named records. Files stand twice in the table: a fact is one of its file and number, texts never move."""
    ship(spark)
    return extract.extract_files(_files(spark, d), ["repo", "file_no"], records=records, number="fact_no").distinct()


def _facts(spark: SparkSession, d: str, *records: str) -> DataFrame:
    return _numbered(spark, d, *records).drop("fact_no")


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "symbol").select("file_no", "name", "kind", "line", "end_line", "exported", "owner")


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "import").select("file_no", F.col("name").alias("specifier"), "kind", "line", "detail")


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "call").select("file_no", F.col("name").alias("callee"), "line", F.col("owner").alias("caller"))


def extract_interface_facts(spark: SparkSession, d: str) -> DataFrame:
    """Components, hooks, handlers, strings, tests, locators, storage keys, routes and requests."""
    got = _facts(spark, d, "component", "hook", "handler", "ui_string", "test", "locator", "storage", "route", "request", "doc")
    return got.select("file_no", "record", "name", "kind", "line", "owner", "detail")


def extract_models(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "model_field").select("file_no", F.col("owner").alias("entity"), F.col("name").alias("field"), "kind", "detail")


def extract_literals(spark: SparkSession, d: str) -> DataFrame:
    """Literals capped at 256 characters, with the hash of the whole value."""
    return _facts(spark, d, "literal").select("file_no", F.col("name").alias("value"), "line", F.col("detail").alias("sha256"))


def extract_summary(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    got = extract.extract_files(_files(spark, d), ["repo", "file_no"], number="fact_no").select("repo", "file_no", "record", "fact_no").distinct()
    return got.groupBy("repo", "record").agg(F.count("*").alias("facts"), F.count_distinct("file_no").alias("files"))


def symbol_node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Node ids: the plain form for the first top-level declaration of a name, else the qualified one with its ordinal."""
    ranked = G.ordinals(_numbered(spark, d, "symbol"), "file_no", "owner", "name", "line", "fact_no")
    enc = X.encode_component
    plain = F.concat(F.lit("symbol:"), F.col("path"), F.lit("#"), F.col("name"))
    full = F.concat(F.lit("symbolq:"), enc(F.col("path")), F.lit("#"), enc(F.col("owner")), F.lit("#"), enc(F.col("name")), F.lit("#"), F.col("ordinal"))
    return ranked.select("file_no", F.when((F.col("owner") == "") & (F.col("ordinal") == 0), plain).otherwise(full).alias("node_id"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls from named functions; a callee has a file where an import binding, or in other languages the file itself, says so."""
    facts = materialize(spark, _facts(spark, d, "symbol", "call", "binding", "export", "import"), "facts")
    return calls.edges(facts, table(spark, d, "source_files", "repo", "path").distinct())


def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """How many calls of each repository and language end in a known file, in none, or are shadowed."""
    got = call_edges(spark, d)
    ext = X.extension(F.col("path")).alias("ext")
    return got.groupBy("repo", ext, "resolution").agg(F.count("*").alias("calls"))


def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What each import of a script means: the file it resolves to, or that it is unresolved or external."""
    facts = _facts(spark, d, "import").filter(F.col("kind").isin("import", "require", "re-export", "export-all"))
    rows = facts.filter(X.extension(F.col("path")).isin(*calls.SCRIPTS)).select("repo", F.col("path").alias("importer"), F.col("name").alias("specifier"), "kind")
    rows = materialize(spark, rows.distinct(), "imports")
    got = V.resolve_imports(rows, table(spark, d, "source_files", "repo", "path").distinct(), ["repo"])
    dep = F.when(F.col("kind") == "require", "import").otherwise(F.col("kind"))
    return rows.join(got, ["repo", "importer", "specifier"]).select("repo", "importer", "specifier", dep.alias("dep"), "status", "target").distinct()


def test_references(spark: SparkSession, d: str) -> DataFrame:
    """What test files call, with the production file of the repository that alone declares the name, if there is one."""
    facts = materialize(spark, _facts(spark, d, "symbol", "call"), "facts")
    test = X.is_test_path(F.col("path"))
    sym = facts.filter((F.col("record") == "symbol") & ~test).groupBy("repo", "name").agg(F.count_distinct("file_no").alias("n"), F.min("file_no").alias("production")).filter("n = 1").drop("n")
    last = F.regexp_extract("name", r"([^.:]+)$", 1)
    called = facts.filter((F.col("record") == "call") & test).select("repo", F.col("file_no").alias("test"), last.alias("name")).distinct()
    return called.join(sym, ["repo", "name"], "left").select("test", "name", "production")


def rust_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between Rust items: implements and supertrait, the trait in the same file or through a use; modules and their files."""
    facts = materialize(spark, _facts(spark, d, "symbol", "relation", "import", "module").filter(X.extension(F.col("path")) == ".rs"), "rust")
    return rust.relations(facts, table(spark, d, "source_files", "repo", "path").distinct())


def framework_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes under the paths of the routers that mount them, at any depth."""
    facts = materialize(spark, _facts(spark, d, "route", "mount"), "routes")
    routes = facts.filter((F.col("record") == "route") & ~F.col("kind").isin("MOUNT", "CONTROLLER")).select(F.col("file_no").alias("scope"), F.col("owner").alias("router"), F.col("kind").alias("method"), F.col("name").alias("path"))
    joins = facts.filter(F.col("record") == "mount").select(F.col("file_no").alias("scope"), F.col("owner").alias("router"), F.col("detail").alias("prefix"), F.col("name").alias("child"))
    return B.mounts(spark, routes, joins)


def language_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a scan over the stored files."""
    raw = _files(spark, d).distinct().select(F.concat_ws("/", F.col("repo"), F.col("path")).alias("rel_path"), F.encode("content", "utf-8").alias("content"), F.length("content").cast("long").alias("size_bytes"))
    return scan.counters(scan.ledger(raw, ["tests"]))


def python_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Top-level definitions of files whose every line is read by a plain scan."""
    files = table(spark, d, "source_files", "file_no", "path", "content").distinct().filter(X.extension(F.col("path")) == ".py")
    got = files.select("file_no", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:async )?(?:def|class) (\w+)"), F.lit(1))).alias("name"))
    return got.groupBy("file_no", "name").agg(F.count("*").alias("n"))


def jvm_imports(spark: SparkSession, d: str) -> DataFrame:
    """Kotlin and Java imports with the package of the file."""
    files = table(spark, d, "source_files", "file_no", "path", "content").distinct().filter(X.extension(F.col("path")).isin(".kt", ".java"))
    package = F.nullif(F.regexp_extract("content", r"(?m)^package ([\w.]+)", 1), F.lit(""))
    one = files.select("file_no", package.alias("package"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^import ([\w.]+)"), F.lit(1))).alias("name"))
    return one.distinct()


def same_package_types(spark: SparkSession, d: str) -> DataFrame:
    """Types that a file mentions, by tiers: an import of the file, else a class of the same package; the best tier counts.

    A file without a package is in none: it sees no other file's classes.
    """
    files = table(spark, d, "source_files", "file_no", "path", "content").filter(X.extension(F.col("path")).isin(".kt", ".java"))
    every = lambda pattern: F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    base = files.select(
        "file_no", F.nullif(F.regexp_extract("content", r"(?m)^package ([\w.]+)", 1), F.lit("")).alias("package"),
        every(r"\bclass (\w+)").alias("declared"), every(r"(?m)^import ([\w.]+)").alias("imported"), every(r"\b([A-Z]\w*)").alias("mentioned"),
    )
    base = materialize(spark, base.dropDuplicates(["file_no"]), "types")
    said = base.select("file_no", "package", F.explode("mentioned").alias("type"))
    tier0 = base.select("file_no", F.explode("imported").alias("target")).select("file_no", F.substring_index("target", ".", -1).alias("type"), F.lit(0).alias("tier"), "target")
    declared = base.filter("package is not null").select("package", F.explode("declared").alias("type")).distinct()
    tier1 = said.join(declared, ["package", "type"]).select("file_no", "type", F.lit(1).alias("tier"), F.concat_ws(".", "package", "type").alias("target"))
    best = F.min("tier").over(Window.partitionBy("file_no", "type"))
    return tier0.unionByName(tier1).distinct().withColumn("best", best).filter("tier = best").select("file_no", "type", "tier", "target")


def stream_replay_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit records played through a stream into the incremental state: the same as the newest hash of each path."""
    from weftline.operators.incremental import ContentState, plain_path
    from weftline.streaming import incremental as I

    src = f"{d}/audit_files.parquet"
    # as a pattern the path may be one file or a folder of them
    stream = I.file_stream(spark, src[:-1] + "[t]", spark.read.parquet(src).schema)
    rows = stream.filter(F.col("path").isNotNull() & F.col("repo").isNotNull()).select("repo", plain_path(F.col("path")).alias("path"), F.lower("content_sha256").alias("content_hash"), F.struct("arrived_at", "arrival_no").alias("o"))
    home = scratch(spark, "stream")
    state = ContentState(spark, f"{home}/state", ["repo", "path"])
    I.keep_up(rows, state, ["repo", "path"], "o", f"{home}/checkpoint", "audit").awaitTermination()
    return state.state().withColumnRenamed("content_hash", "content_sha256")


QUERIES = {f.__name__: f for f in (
    extract_symbols, extract_imports, extract_calls, extract_interface_facts, extract_models, extract_literals,
    extract_summary, symbol_node_ids, call_edges, call_resolution, file_dependencies, test_references, rust_relations, framework_routes, language_ledger, python_definitions,
    jvm_imports, same_package_types, stream_replay_audit,
)}

_EXT = r"lower(regexp_extract(string_split(path, '/')[-1], '(\.[^.]+)$', 1))"
SQL = {
    "python_definitions": rf"""
WITH f AS (SELECT DISTINCT file_no, path, content FROM source_files), n AS (
  SELECT file_no, unnest(regexp_extract_all(content, '(?m)^(?:async )?(?:def|class) (\w+)', 1)) AS name FROM f WHERE {_EXT} = '.py')
SELECT file_no, name, count(*) AS n FROM n GROUP BY ALL""",
    "jvm_imports": rf"""
WITH f AS (SELECT DISTINCT file_no, path, content FROM source_files)
SELECT DISTINCT file_no, nullif(regexp_extract(content, '(?m)^package ([\w.]+)', 1), '') AS package, unnest(regexp_extract_all(content, '(?m)^import ([\w.]+)', 1)) AS name
FROM f WHERE {_EXT} IN ('.kt', '.java')""",
    "same_package_types": rf"""
WITH f AS (SELECT DISTINCT file_no, nullif(regexp_extract(content, '(?m)^package ([\w.]+)', 1), '') AS package, content FROM source_files WHERE {_EXT} IN ('.kt', '.java')),
t0 AS (SELECT DISTINCT file_no, unnest(regexp_extract_all(content, '(?m)^import ([\w.]+)', 1)) AS target FROM f),
dc AS (SELECT DISTINCT package, unnest(regexp_extract_all(content, '\bclass (\w+)', 1)) AS type FROM f WHERE package IS NOT NULL),
said AS (SELECT DISTINCT file_no, package, unnest(regexp_extract_all(content, '\b([A-Z]\w*)', 1)) AS type FROM f),
e AS (SELECT file_no, string_split(target, '.')[-1] AS type, 0 AS tier, target FROM t0
  UNION SELECT s.file_no, s.type, 1, s.package || '.' || s.type FROM said s JOIN dc ON dc.package = s.package AND dc.type = s.type),
b AS (SELECT *, min(tier) OVER (PARTITION BY file_no, type) AS best FROM e)
SELECT file_no, type, tier, target FROM b WHERE tier = best""",
    "language_ledger": rf"""
WITH f AS (SELECT DISTINCT repo, file_no, path, content FROM source_files), p AS (SELECT concat_ws('/', repo, path) AS rel, content, {_EXT} AS ext FROM f),
s AS (SELECT content, CASE WHEN rel = 'tests' OR starts_with(rel, 'tests/') THEN 'user-excluded'
  WHEN len(list_intersect(string_split(rel, '/')[1:-2], ['node_modules', 'target', '.next', 'dist', 'build', 'coverage', 'playwright-report', 'test-results', 'output', 'out', '.cache', '.turbo', '.vercel', '.git', '.pytest_cache', '__pycache__', '.venv', 'venv', '.gradle'])) > 0 THEN 'ignored-folder'
  WHEN regexp_matches(rel, '\.d\.[cm]?ts$') THEN 'declaration-file'
  WHEN ext NOT IN ('.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.py', '.kt', '.kts', '.java', '.rs') THEN 'unsupported' ELSE 'supported' END AS status FROM p)
SELECT status, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS bytes FROM s GROUP BY status""",
    "stream_replay_audit": r"""
SELECT repo, regexp_replace(replace(path, chr(92), '/'), '^(\./)+', '') AS path, arg_max(h, (arrived_at, arrival_no)) AS content_sha256
FROM (SELECT repo, path, coalesce(lower(content_sha256), chr(0)) AS h, arrived_at, arrival_no FROM audit_files WHERE path IS NOT NULL AND repo IS NOT NULL) GROUP BY 1, 2""",
}
SQL["stream_replay_audit"] = "SELECT repo, path, nullif(content_sha256, chr(0)) AS content_sha256 FROM (" + SQL["stream_replay_audit"] + ")"
