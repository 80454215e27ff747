"""Resolution of names, imports, calls and selectors. Several matches are reported, never guessed among."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import dirname, normalize
from weftline.session import MOST_PARTITIONS, materialize

# fixed values: what is tried for a relative import without an extension, in order
PROBES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
# written extensions that stand for a source file of another one
SWAPS = ((".js", ".ts"), (".js", ".tsx"), (".jsx", ".tsx"))
# rows of either side in a block of pairs, about, and pairs that one task gives, about
BLOCK_SIDE = 512
TASK_PAIRS = 1 << 20


def import_candidates(importer: Column, specifier: Column) -> Column:
    """The paths a relative specifier may mean, in order of preference, as array of struct(rank, path)."""
    base = normalize(F.concat(F.when(dirname(importer) == ".", F.lit("")).otherwise(F.concat(dirname(importer), F.lit("/"))), specifier))
    plain = [F.struct(F.lit(i).alias("rank"), F.concat(base, F.lit(p)).alias("path")) for i, p in enumerate(PROBES)]
    swaps = [
        F.when(specifier.endswith(a), F.struct(F.lit(len(PROBES) + i).alias("rank"), F.concat(F.regexp_replace(base, a.replace(".", r"\.") + "$", ""), F.lit(b)).alias("path")))
        for i, (a, b) in enumerate(SWAPS)
    ]
    return F.filter(F.array(*plain, *swaps), lambda c: c.isNotNull())


def resolve_imports(imports: DataFrame, inventory: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, importer, specifier, status, target): the first probe that is in the inventory.

    `imports` has the scope columns, importer and specifier; `inventory` the scope columns and path. status: resolved,
    unresolved, or external for a specifier that is not relative.
    """
    keys = [*scope, "importer", "specifier"]
    rows = imports.select(*keys).distinct()
    relative = rows.filter(F.col("specifier").startswith("."))
    tried = relative.select(*keys, F.explode(import_candidates(F.col("importer"), F.col("specifier"))).alias("c")).select(*keys, "c.rank", "c.path")
    hit = tried.join(inventory.select(*scope, "path").distinct(), [*scope, "path"])
    best = hit.groupBy(*keys).agg(F.min(F.struct("rank", "path"))["path"].alias("target"))
    status = F.when(~F.col("specifier").startswith("."), "external").when(F.col("target").isNull(), "unresolved").otherwise("resolved")
    return rows.join(best, keys, "left").select(*keys, status.alias("status"), "target")


def resolve_aliases(specifiers: DataFrame, rules: DataFrame) -> DataFrame:
    """(specifier, target): path-alias rules (pattern, replacement), `*` for the rest.

    An exact pattern beats a wildcard, a longer literal prefix a shorter one; a tie resolves to nothing. Rules are a
    configuration, whose count does not grow with the data.
    """
    star = F.instr("pattern", "*")
    rule = rules.distinct().withColumn("_prefix", F.when(star > 0, F.substring("pattern", F.lit(1), star - 1)).otherwise(F.col("pattern")))
    rule = rule.withColumn("_suffix", F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).otherwise(F.lit("")))
    rule = rule.withColumn("_exact", star == 0)
    fits = F.when(F.col("_exact"), F.col("specifier") == F.col("pattern")).otherwise(
        F.col("specifier").startswith(F.col("_prefix")) & F.col("specifier").endswith(F.col("_suffix"))
        & (F.length("specifier") >= F.length("_prefix") + F.length("_suffix"))
    )
    first = F.substring("specifier", 1, 1)
    keyed = specifiers.select("specifier").distinct().withColumn("_head", first)
    ruled = rule.withColumn("_head", F.substring("_prefix", 1, 1))
    hits = keyed.join(ruled, "_head").filter(fits).select("specifier", "pattern", "replacement", "_prefix", "_suffix", "_exact")
    # rules without a literal prefix fit anywhere: they differ in their suffix alone, so they are few
    cell = F.struct("pattern", "replacement", "_prefix", "_suffix", "_exact")
    general = ruled.filter(F.col("_head") == "").agg(F.collect_set(cell).alias("all")).scalar()
    anywhere = keyed.withColumn("all", general).select("specifier", F.explode("all").alias("r")).select("specifier", "r.*").filter(fits).select(hits.columns)
    scored = hits.unionByName(anywhere).withColumn("_score", F.when(F.col("_exact"), F.lit(1 << 20)).otherwise(F.length("_prefix")))
    w = Window.partitionBy("specifier")
    best = scored.withColumn("_top", F.max("_score").over(w)).filter("_score = _top")
    rest = F.substring(F.col("specifier"), F.length("_prefix") + 1, F.length("specifier") - F.length("_prefix") - F.length("_suffix"))
    target = F.when(F.col("_exact"), F.col("replacement")).otherwise(F.replace(F.col("replacement"), F.lit("*"), rest))
    one = best.groupBy("specifier").agg(F.count("*").alias("n"), F.min(target).alias("t"))
    return keyed.drop("_head").join(one, "specifier", "left").select("specifier", F.when(F.col("n") == 1, F.col("t")).alias("target"))


def qualify(calls: DataFrame, endpoints: DataFrame, on: list[str], most: int = 64) -> DataFrame:
    """(call, qualification, target, candidates): RESOLVED by one endpoint, AMBIGUOUS by several, UNRESOLVED by none.

    `calls` has call and the columns of `on`, `endpoints` endpoint and the same. At most `most` candidates are listed;
    n has their full number, and candidates() gives every one.
    """
    pairs = calls.join(endpoints.select("endpoint", *on).distinct(), on, "left")
    per = pairs.groupBy("call").agg(F.count_distinct("endpoint").alias("n"), F.min("endpoint").alias("one"))
    rank = F.row_number().over(Window.partitionBy("call").orderBy("endpoint"))
    listed = (
        pairs.filter(F.col("endpoint").isNotNull()).select("call", "endpoint").distinct().withColumn("k", rank)
        .filter(F.col("k") <= most).groupBy("call").agg(F.array_join(F.array_sort(F.collect_list("endpoint")), "|").alias("candidates"))
    )
    name = F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return per.join(listed, "call", "left").select(
        "call", name.alias("qualification"), F.when(F.col("n") == 1, F.col("one")).alias("target"), F.col("n"),
        F.when(F.col("n") > 1, F.col("candidates")).alias("candidates"),
    )


def candidates(calls: DataFrame, endpoints: DataFrame, on: list[str]) -> DataFrame:
    """(call, endpoint, n): every endpoint of every call, with how many the call has; calls without one give no row."""
    pairs = calls.select("call", *on).distinct().join(endpoints.select("endpoint", *on).distinct(), on).select("call", "endpoint").distinct()
    return pairs.join(pairs.groupBy("call").agg(F.count("*").alias("n")), "call")


def pairs_through(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """(owner, via, used): every owner with every used node of the same via, each triple once.

    `ends` has via, end and owns: whether end is an owner there, else it is used. Ends are made distinct before they meet,
    so no pair is compared or moved afterwards. A via of m owners and n used nodes is cut into a grid of blocks, and each
    end is copied to the blocks of its row or column: what moves is the ends and some 1/256 of the pairs, and a task's
    pairs follow from the count of all pairs, not from the degree of one node.
    """
    ends = ends.distinct()
    per = ends.groupBy("via").agg(F.count_if("owns").alias("m"), F.count_if(~F.col("owns")).alias("n")).filter("m > 0 AND n > 0")
    met = materialize(spark, ends.join(per, "via"), "ends")
    total = met.filter("owns").agg(F.sum("n")).first()[0] or 0
    parts = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_PAIRS + 1))
    rows, cols = F.ceil(F.col("m") / BLOCK_SIDE), F.ceil(F.col("n") / BLOCK_SIDE)
    own = F.pmod(F.xxhash64("end"), F.when(F.col("owns"), rows).otherwise(cols))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("owns"), cols).otherwise(rows) - 1))
    placed = met.select("via", "end", "owns", own.alias("own"), copies.alias("copy")).select(
        "via", F.when(F.col("owns"), F.col("own")).otherwise(F.col("copy")).alias("row"), F.when(F.col("owns"), F.col("copy")).otherwise(F.col("own")).alias("col"),
        F.when(F.col("owns"), F.col("end")).alias("owner"), F.when(~F.col("owns"), F.col("end")).alias("used"),
    )
    block = placed.repartition(parts, "via", "row", "col").groupBy("via", "row", "col").agg(F.collect_list("owner").alias("owners"), F.collect_list("used").alias("used"))
    return block.select("via", "owners", F.explode("used").alias("used")).select(F.explode("owners").alias("owner"), "via", "used")


def cascade(df: DataFrame, key: str, tests: list[tuple[str, Column]]) -> DataFrame:
    """(key, match_kind): the first test a row meets; rows that meet none are left out, repeated keys are one."""
    kind, rank = None, None
    for i, (name, test) in enumerate(tests):
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        rank = F.when(test, i) if rank is None else rank.when(test, i)
    hit = df.withColumn("_k", kind).withColumn("_r", rank).filter(F.col("_k").isNotNull())
    return hit.groupBy(key).agg(F.min(F.struct("_r", "_k"))["_k"].alias("match_kind"))


def relationship_query(edges: DataFrame, filters: dict[str, str | None], order: list[str], most: int) -> DataFrame:
    """The first `most` (1 to 256) edges that meet all given filters, with the total and whether the list is complete."""
    if not 1 <= most <= 256:
        raise ValueError("the cap is 1 to 256")
    hit = edges
    for column, value in filters.items():
        if value is not None:
            hit = hit.filter(F.col(column) == value)
    total = hit.agg(F.count("*").alias("total")).scalar()
    return hit.orderBy(*order).limit(most).withColumn("total", total).withColumn("complete", F.col("total") <= most)


def target_proof(targets: DataFrame, inventory: DataFrame, roots: list[str]) -> DataFrame:
    """(path, verdict): present, outside-selected-roots, proven-missing, or indeterminate for a path that is not canonical."""
    from weftline.functions.text import canonical_path

    inside = None
    for r in roots:
        test = F.col("path").startswith(r.rstrip("/") + "/")
        inside = test if inside is None else inside | test
    there = inventory.select("path").distinct().withColumn("_there", F.lit(True))
    verdict = (
        F.when(F.col("_there"), "present").when(~canonical_path(F.col("path")), "indeterminate")
        .when(~inside, "outside-selected-roots").otherwise("proven-missing")
    )
    return targets.select("path").distinct().join(there, "path", "left").select("path", verdict.alias("verdict"))
