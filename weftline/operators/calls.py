"""Edges of calls: a callee is known through import bindings in scripts, within the file in other languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import extension
from weftline.operators.resolve import resolve_imports

SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
CALLABLE = ("function", "fun", "method", "constructor")


def import_targets(facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(repo, path, local, target, symbol, line): the declaration that each import binding of a script stands for.

    The specifier resolves to one file; there the imported name is what exactly one export gives it, a declaration, an
    alias, a default or a CommonJS member. A binding of a whole module gives one row for each export, as local.name.
    Bindings of types stand for nothing that can be called.
    """
    bindings = facts.filter((F.col("record") == "binding") & (F.col("kind") != "type")).select("repo", "path", F.col("name").alias("local"), F.col("owner").alias("imported"), F.col("detail").alias("specifier")).distinct()
    resolved = resolve_imports(bindings.select("repo", F.col("path").alias("importer"), "specifier"), inventory, ["repo"])
    resolved = resolved.filter(F.col("status") == "resolved").select("repo", F.col("importer").alias("path"), "specifier", "target")
    exports = facts.filter((F.col("record") == "export") & (F.col("kind") != "re-export")).select("repo", F.col("path").alias("target"), F.col("name").alias("exported"), F.col("owner").alias("symbol"))
    one = exports.distinct().groupBy("repo", "target", "exported").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).filter("n = 1").drop("n")
    declared = facts.filter((F.col("record") == "symbol") & (F.col("owner") == "") & ~F.col("kind").isin("interface", "type")).groupBy("repo", F.col("path").alias("target"), F.col("name").alias("symbol")).agg(F.count("*").alias("n"), F.min("line").alias("line")).filter("n = 1").drop("n")
    known = one.join(declared, ["repo", "target", "symbol"])
    bound = bindings.join(resolved, ["repo", "path", "specifier"])
    named = bound.filter("imported <> '*'").join(known.withColumnRenamed("exported", "imported"), ["repo", "target", "imported"]).select("repo", "path", "local", "target", "symbol", "line")
    whole = bound.filter("imported = '*'").join(known, ["repo", "target"])
    members = whole.select("repo", "path", F.concat_ws(".", "local", "exported").alias("local"), "target", "symbol", "line")
    itself = whole.filter("exported = 'default'").select("repo", "path", "local", "target", "symbol", "line")
    got = named.unionByName(members).unionByName(itself).distinct()
    return got.groupBy("repo", "path", "local").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("target", "symbol", "line")]).filter("n = 1").drop("n")


def edges(facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(repo, path, caller, caller_line, callee, call_line, target, symbol, symbol_line, resolution) of calls in named functions.

    `facts` has repo, path and the fields of a fact (records symbol, call, binding, export); `inventory` repo and path.
    In scripts a callee is known only through import_targets(), and not where the file or a function declares the name
    (kinds local and shadowed of a call). In other languages a plain
    name, or the last part of one, is known if the file declares it exactly once as something callable. resolution:
    import, local, shadowed or unknown.
    """
    script = extension(F.col("path")).isin(*SCRIPTS)
    called = facts.filter((F.col("record") == "call") & (F.col("owner") != "") & (F.col("kind") != "new")).select(
        "repo", "path", F.col("owner").alias("caller"), F.col("end_line").alias("caller_line"), F.col("name").alias("callee"),
        F.col("line").alias("call_line"), F.col("kind").isin("shadowed", "local").alias("shadowed"), script.alias("script"),
    )
    through = import_targets(facts, inventory).select("repo", "path", F.col("local").alias("callee"), "target", "symbol", F.col("line").alias("symbol_line"))
    imported = called.filter("script and not shadowed").join(through, ["repo", "path", "callee"], "left")
    own = facts.filter((F.col("record") == "symbol") & F.col("kind").isin(*CALLABLE) & ~script).groupBy("repo", "path", F.col("name").alias("last")).agg(F.count("*").alias("n"), F.min("line").alias("symbol_line")).filter("n = 1").drop("n")
    rest = called.filter("not script").withColumn("last", F.regexp_extract("callee", r"([^.:]+)$", 1)).join(own, ["repo", "path", "last"], "left")
    here = F.col("symbol_line").isNotNull()
    rest = rest.withColumn("target", F.when(here, F.col("path"))).withColumn("symbol", F.when(here, F.col("last"))).drop("last")
    hidden = called.filter("script and shadowed").withColumns({"target": F.lit(None).cast("string"), "symbol": F.lit(None).cast("string"), "symbol_line": F.lit(None).cast("int")})
    every = imported.unionByName(rest).unionByName(hidden)
    how = F.when(F.col("shadowed"), "shadowed").when(F.col("target").isNull(), "unknown").when(F.col("script"), "import").otherwise("local")
    return every.select("repo", "path", "caller", "caller_line", "callee", "call_line", "target", "symbol", "symbol_line", how.alias("resolution"))
