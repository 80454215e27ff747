"""Relations between Rust items of a repository: implemented traits, supertraits, used items and module files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.bundle import module_files


def relations(facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(repo, path, kind, source, target, target_path, status).

    kind: implements, supertrait, uses or module. A named item is that of the file if it declares the name once, else the
    one that a use of the file names by its last part and that exactly one file of the repository declares; else it is
    unresolved, or ambiguous if several files declare it. A module's target is its file, see module_files().
    """
    items = facts.filter((F.col("record") == "symbol") & F.col("kind").isin("struct", "enum", "union", "trait", "function", "type", "const", "module") & (F.col("owner") == ""))
    here = items.groupBy("repo", "path", F.col("name").alias("target")).agg(F.lit(True).alias("here"))
    every = items.groupBy("repo", F.col("name").alias("last")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("only"))
    last = F.substring_index("name", "::", -1)
    used = facts.filter((F.col("record") == "import") & (F.col("kind") == "use")).select("repo", "path", F.col("name").alias("full"), F.when(F.col("detail") != "", F.col("detail")).otherwise(last).alias("target"), last.alias("last")).distinct()
    related = facts.filter(F.col("record") == "relation").select("repo", "path", "kind", F.col("owner").alias("source"), F.col("name").alias("target")).distinct()
    told = used.groupBy("repo", "path", "target").agg(F.count_distinct("full").alias("m"), F.min("last").alias("last"))
    got = related.join(here, ["repo", "path", "target"], "left").join(told, ["repo", "path", "target"], "left").join(every, ["repo", "last"], "left")
    found = F.when(F.col("here"), F.col("path")).when((F.col("m") == 1) & (F.col("n") == 1), F.col("only"))
    status = F.when(found.isNotNull(), "resolved").when((F.col("m") > 1) | (F.col("n") > 1), "ambiguous").otherwise("unresolved")
    named = got.select("repo", "path", "kind", "source", "target", found.alias("target_path"), status.alias("status"))
    uses = used.join(every, ["repo", "last"], "left").select(
        "repo", "path", F.lit("uses").alias("kind"), F.col("path").alias("source"), F.col("full").alias("target"), F.when(F.col("n") == 1, F.col("only")).alias("target_path"),
        F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"),
    )
    declared = facts.filter(F.col("record") == "module").select("repo", "path", "name").distinct()
    modules = module_files(declared, inventory, ["repo"]).select("repo", "path", F.lit("module").alias("kind"), F.col("path").alias("source"), F.col("name").alias("target"), F.col("target").alias("target_path"), "status")
    return named.unionByName(uses).unionByName(modules)
