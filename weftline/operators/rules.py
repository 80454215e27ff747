"""Rule-based classification, confidence merges and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import basename

# fixed values: confidence levels from low to high, for classes and for observations
CLASS_LEVELS = ("possible", "likely", "certain")
LINEAGE_LEVELS = ("unknown", "partial", "inferred-static", "explicit")
REACH_LEVELS = ("low", "medium", "high")


def level(c: Column, levels: tuple[str, ...]) -> Column:
    """The rank of a level name; null and unknown names rank below all."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in levels]), c), F.lit(0)).cast("int")


def file_rules(path: Column, content: Column | None = None) -> Column:
    """Matched rules of a file as an array of (role, confidence)."""
    base = basename(path)
    says = content if content is not None else F.lit("")

    def rule(test: Column, role: str, confidence: Column | str) -> Column:
        c = F.lit(confidence) if isinstance(confidence, str) else confidence
        return F.when(test, F.struct(F.lit(role).alias("role"), c.alias("confidence")))

    return F.filter(F.array(
        rule(path.rlike(r"(^|/)generated/|\.(generated|gen)\.[jt]sx?$"), "generated-file", "likely"),
        rule(base.rlike(r"\.config\.[jt]s$|^tsconfig.*\.json$|^package\.json$|^\..*rc$"), "configuration-file", "likely"),
        rule(path.rlike(r"(^|/)commands/.*") & base.rlike(r"Command\.ts$"), "command-handler",
             F.when(says.rlike(r"export\s+(async\s+)?function\s+register\w*Command"), "certain").otherwise("likely")),
        rule(base.rlike(r"(?i)valid(ate|ation|ator)") | path.rlike(r"(^|/)validators/"), "validator",
             F.when(says.rlike(r"export\s+function\s+(is|assert)[A-Z]\w*"), "likely").otherwise("possible")),
        rule(base.rlike(r"(?i)analy[sz]er|^build|^apply"), "analyzer", F.when(base.rlike(r"(?i)analy[sz]er"), "likely").otherwise("possible")),
        rule(path.rlike(r"(^|/)tests/") | base.rlike(r"\.spec\."), "test-fixture", "certain"),
        rule(path.rlike(r"(^|/)planning/"), "internal-planning-docs", "certain"),
        rule(path.rlike(r"(^|/)docs/.*\.md$") | base.rlike(r"(?i)^readme"), "public-docs", "likely"),
    ), lambda r: r.isNotNull())


def resolve(matched: Column) -> Column:
    """Only the candidates of the best confidence; if there are several, all are kept as `possible` and conflict.

    Gives struct(classes array<(role, confidence)>, conflict boolean). No match gives no classes.
    """
    rank = F.transform(matched, lambda r: level(r["confidence"], CLASS_LEVELS))
    best = F.filter(matched, lambda r: level(r["confidence"], CLASS_LEVELS) == F.array_max(rank))
    tied = F.size(best) > 1
    kept = F.when(tied, F.transform(best, lambda r: F.struct(r["role"].alias("role"), F.lit("possible").alias("confidence")))).otherwise(best)
    return F.struct(kept.alias("classes"), tied.alias("conflict"))


# fixed values: guidance in order of priority, by role
GUIDANCE = (
    ("generated-file", "generated-do-not-edit"), ("configuration-file", "inspect-before-edit"),
    ("internal-planning-docs", "read-only-reference"), ("public-docs", "docs-only"), ("test-fixture", "test-only"),
)
PRIMARY = ("command-handler", "analyzer", "validator")


def guidance(classes: Column) -> Column:
    """What may be done with a file, the first rule that fits."""
    has = lambda role: F.exists(classes, lambda r: r["role"] == role)
    out = None
    for role, says in GUIDANCE:
        out = F.when(has(role), says) if out is None else out.when(has(role), says)
    sure = F.exists(classes, lambda r: r["role"].isin(*PRIMARY) & (r["confidence"] != "possible"))
    return (
        out.when(F.size(classes) == 0, "uncertain").when(F.exists(classes, lambda r: r["confidence"] == "possible"), "inspect-before-edit")
        .when(sure, "safe-primary-edit-target").otherwise("inspect-before-edit")
    )


def merged_confidence(df: DataFrame, key: list[str], confidence: str, levels: tuple[str, ...], lower: bool) -> DataFrame:
    """(key, confidence): of several observations the lower or the higher level; nulls and unknown names rank lowest."""
    rank = level(F.col(confidence), levels)
    pick = F.min(rank) if lower else F.max(rank)
    names = F.array(*[F.lit(x) for x in levels])
    return df.groupBy(*key).agg(pick.alias("_r")).select(*key, F.when(F.col("_r") > 0, F.element_at(names, F.greatest(F.col("_r"), F.lit(1)))).alias(confidence))


def upsert(rows: DataFrame, key: str, order: str, scalars: list[str], confidence: str, levels: tuple[str, ...], evidence: str) -> DataFrame:
    """One row for each key: the higher confidence, of each scalar the first that is not null, all evidence sorted."""
    first = [
        F.min(F.when(F.col(s).isNotNull(), F.struct(F.col(order), F.col(s).alias("v"))))["v"].alias(s) for s in scalars
    ]
    best = F.max(level(F.col(confidence), levels))
    names = F.array(*[F.lit(x) for x in levels])
    return (
        rows.groupBy(key).agg(best.alias("_r"), *first, F.array_sort(F.array_distinct(F.flatten(F.collect_set(evidence)))).alias(evidence))
        .withColumn(confidence, F.when(F.col("_r") > 0, F.element_at(names, F.greatest(F.col("_r"), F.lit(1))))).drop("_r")
    )


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def single_match(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, status, right): found with its one match, ambiguous, or not-found; `right` is null in `pairs` for none."""
    n = F.count_distinct(F.col(right))
    return pairs.groupBy(left).agg(n.alias("n"), F.min(right).alias("_m")).select(
        left, F.when(F.col("n") == 0, "not-found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("status"),
        F.when(F.col("n") == 1, F.col("_m")).alias(right), F.col("n").alias("candidates"),
    )
