"""Weighted search over fields: candidates, relevance, ownership tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import shorten, tokenize

# fixed values: weights of the search fields, the bonus for all terms and the factor of a whole phrase
WEIGHTS = {
    "path": 8, "label": 6, "symbolName": 12, "symbolKind": 4, "import": 5, "export": 10, "edgeKind": 3, "nodeId": 4,
    "neighbor": 2, "semanticRole": 7, "semanticSubtype": 6, "semanticSource": 2, "semanticArtifactRef": 3,
    "frontendValue": 14, "classificationRole": 7, "classificationEditGuidance": 3, "androidComponentRole": 7,
    "androidMetadata": 6,
}
EDGE_WEIGHTS = {"nodeId": 1, "neighbor": 1}
ALL_TERMS_BONUS = 10
PHRASE_FACTOR = 2
SEEDS, TARGETS_PER_SEED, TARGETS = 20, 16, 128


def fields(df: DataFrame, kind: str, key: Column, columns: dict[str, Column], path: Column | None = None) -> DataFrame:
    """(kind, id, path, field, text, weight): one row for each non-null field value of a candidate."""
    weight = WEIGHTS | (EDGE_WEIGHTS if kind == "edge" else {})
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), c.cast("string").alias("text"), F.lit(weight[f]).alias("weight"))
        for f, c in columns.items()
    ])
    where = path if path is not None else F.lit(None).cast("string")
    rows = df.select(F.lit(kind).alias("kind"), key.alias("id"), where.alias("path"), F.explode(cells).alias("c"))
    return rows.filter(F.col("c.text").isNotNull()).select("kind", "id", "path", "c.field", "c.text", "c.weight")


def relevance(candidates: DataFrame, query: str) -> DataFrame:
    """(kind, id, path, score, matched_terms, reasons) of the candidates with any match.

    Each field that holds the whole phrase gives its weight twice, each that holds a term its weight once. Equal
    reasons (field, term, shortened text, weight) count once. The bonus needs as many different matched terms as the
    query has terms, so a repeated term forfeits it. One shuffle: reasons are sets, merged before it.
    """
    terms = tokenize(query)
    phrase = query.strip().lower()
    asked = [(phrase, PHRASE_FACTOR, False)] * bool(phrase) + [(t, 1, True) for t in dict.fromkeys(terms)]
    low = F.lower("text")
    shape = "array<struct<field: string, term: string, is_term: boolean, text: string, weight: int>>"
    tests = F.array().cast(shape) if not asked else F.array(*[
        F.when(low.contains(t), F.struct(
            F.col("field"), F.lit(t).alias("term"), F.lit(is_term).alias("is_term"), shorten(F.col("text")).alias("text"),
            (F.col("weight") * factor).alias("weight"),
        ))
        for t, factor, is_term in asked
    ])
    hits = candidates.select("kind", "id", "path", F.explode(tests).alias("r")).filter(F.col("r").isNotNull())
    per = hits.groupBy("kind", "id").agg(F.min("path").alias("path"), F.collect_set("r").alias("reasons"))
    total = F.aggregate("reasons", F.lit(0).cast("long"), lambda a, r: a + r["weight"])
    matched = F.size(F.array_distinct(F.transform(F.filter("reasons", lambda r: r["is_term"]), lambda r: r["term"])))
    score = total + F.when(matched == len(terms), ALL_TERMS_BONUS).otherwise(0)
    return per.select("kind", "id", "path", score.alias("score"), matched.cast("long").alias("matched_terms"), "reasons")


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best candidates: score down, kind, path or id, id; ties are broken to the end."""
    return scored.orderBy(F.desc("score"), "kind", F.coalesce("path", "id"), "id").limit(limit)


def reason_order(reasons: Column) -> Column:
    """Reasons by weight down, then field, term and text."""
    return F.array_sort(F.transform(reasons, lambda r: F.struct((-r["weight"]).alias("w"), r["field"], r["term"], r["text"])))


def scoped(candidates: DataFrame, query: str) -> DataFrame:
    """An exact id narrows the pool to that candidate; words that equal a path narrow it to those paths.

    Decided in the plan, by flags over the pool, not by a job of its own.
    """
    words = [w for w in query.split() if w]
    exact, here = F.col("id") == query.strip(), F.col("path").isin(words) if words else F.lit(False)
    flag = candidates.agg(F.when(F.bool_or(exact), "exact").when(F.bool_or(here), "path").alias("f")).scalar()
    narrow = F.coalesce(F.col("_f"), F.lit(""))
    keep = F.when(narrow == "exact", exact).when(narrow == "path", here).otherwise(F.lit(True))
    return candidates.withColumn("_f", flag).filter(keep).drop("_f")


def ceiling(scored: DataFrame, exact: Column) -> DataFrame:
    """Results without an exact name stay below the least exact one."""
    least = scored.filter(exact).agg(F.min("score").alias("least")).scalar()
    capped = F.when(exact | F.col("_least").isNull(), F.col("score")).otherwise(F.least("score", F.col("_least") - 1))
    return scored.withColumn("_least", least).withColumn("score", capped).drop("_least")


def recover_owners(seeds: DataFrame, deps: DataFrame) -> DataFrame:
    """Direct dependencies of the best seeds: (target, seed_count, best_seed_score, seed_rank).

    `seeds` has id and score, `deps` source and target. The best SEEDS seeds give up to TARGETS_PER_SEED targets each, in
    order of target; over all, the TARGETS that appear first. Targets that are seeds themselves are left out.
    """
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    best = seeds.orderBy(F.desc("score"), "id").limit(SEEDS).withColumn("seed_rank", rank)  # at most SEEDS rows
    pairs = deps.join(F.broadcast(best), deps["source"] == best["id"]).select("seed_rank", "score", "target").distinct()
    fresh = pairs.join(F.broadcast(best.select(F.col("id").alias("target"))), "target", "left_anti")
    kept = fresh.withColumn("n", F.row_number().over(Window.partitionBy("seed_rank").orderBy("target"))).filter(F.col("n") <= TARGETS_PER_SEED)
    per = kept.groupBy("target").agg(
        F.count("*").alias("seed_count"), F.max("score").alias("best_seed_score"), F.min("seed_rank").alias("seed_rank")
    )
    return per.orderBy("seed_rank", "target").limit(TARGETS)


def tiers(df: DataFrame, eligible: Column, owner: Column) -> Column:
    """0 direct-owner, 1 production-candidate, 2 supporting-evidence."""
    return F.when(eligible & owner, 0).when(eligible, 1).otherwise(2)
