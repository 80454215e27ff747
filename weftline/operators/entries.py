"""Classification entries of symbols: candidates from known roles and from reachability, merged, with invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.rules import CLASS_LEVELS, level

# fixed values: roles that decide guidance and risks
STORED, SHAPED = ("database-model", "persistence-adapter"), ("view-model", "projection-type")
SHOWN, PUBLIC = ("client-component", "server-component", "ui-only-state"), ("canonical-type", "artifact-type", "route-handler")


def _any(roles: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(roles, F.array(*[F.lit(x) for x in wanted]))


def symbol_entries(symbols: DataFrame, known: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, roles, uncertainty, conflict, evidence, guidance, readiness, risks) of each symbol.

    `symbols` has id; `known` id, role, confidence (a class level); `reach` id, role, gated. A reachability fact is a
    likely candidate if something gates it, else a possible one. Only candidates of the best level count; several roles
    there conflict and are all possible. A symbol without candidates is unknown. Repeated rows are one; null ids are
    left out. `roles` and `risks` are sorted.
    """
    told = known.select("id", "role", F.coalesce("confidence", F.lit("possible")).alias("tier"), F.lit(None).cast("boolean").alias("gated"))
    met = reach.select("id", "role", F.when(F.col("gated"), "likely").otherwise("possible").alias("tier"), F.coalesce("gated", F.lit(False)).alias("gated"))
    cand = told.unionByName(met).filter(F.col("id").isNotNull() & F.col("role").isNotNull()).withColumn("rank", level(F.col("tier"), CLASS_LEVELS))
    per = cand.groupBy("id", "role").agg(F.max("rank").alias("rank"), F.max("gated").alias("gated"))
    best = per.groupBy("id").agg(F.max("rank").alias("best"), F.max("gated").alias("gated"), F.count("*").alias("evidence"))
    kept = per.select("id", "role", "rank").join(best, "id").filter("rank = best")
    one = kept.groupBy("id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.first("best").alias("best"), F.first("gated").alias("gated"), F.first("evidence").alias("evidence"))
    rows = symbols.select("id").filter(F.col("id").isNotNull()).distinct().join(one, "id", "left")
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    conflict = F.size(roles) > 1
    tier = F.when(F.size(roles) == 0, "unknown").when(conflict, "possible").otherwise(F.element_at(F.array(*[F.lit(x) for x in CLASS_LEVELS]), F.greatest(F.col("best"), F.lit(1))))
    rows = rows.select("id", roles.alias("roles"), tier.alias("uncertainty"), conflict.alias("conflict"), F.coalesce("evidence", F.lit(0)).alias("evidence"), "gated")
    t, r = F.col("uncertainty"), F.col("roles")
    guidance = (
        F.when(t == "unknown", "uncertain").when(_any(r, STORED), F.when(t == "certain", "avoid-primary-edit-target").otherwise("inspect-before-edit"))
        .when(_any(r, SHAPED) & t.isin("certain", "likely"), "safe-primary-edit-target").otherwise("inspect-before-edit")
    )
    ready = F.when(F.col("conflict"), "risky-assumption").when(t.isin("possible", "unknown"), "needs-more-context").otherwise("ready")
    open_ = ~F.coalesce("gated", F.lit(False))
    risks = F.filter(F.array(
        F.when(F.array_contains(r, "route-handler") & F.col("gated").isNotNull() & open_, "unreachable-ui-risk"), F.when(_any(r, PUBLIC), "public-contract-risk"),
        F.when(_any(r, SHOWN) & open_, "requires-browser-validation"), F.when(_any(r, STORED), "wrong-layer-risk"),
    ), lambda x: x.isNotNull())
    return rows.select("id", "roles", "uncertainty", "conflict", "evidence", guidance.alias("guidance"), ready.alias("readiness"), F.array_sort(risks).alias("risks"))


def component_roles(entries: DataFrame, components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Entries with the roles of their components added; advisory wrong-layer-risk where a dependency is not settled.

    `entries` has id, roles, risks; `components` id, role; `dependencies` source, candidate. A component without a
    supported dependency is no risk. Guidance, readiness and uncertainty stay as they are.
    """
    more = components.groupBy("id").agg(F.collect_set("role").alias("_more"))
    risky = dependencies.groupBy(F.col("source").alias("id")).agg(F.bool_or("candidate").alias("_risky"))
    none = F.array().cast("array<string>")
    got = entries.join(more, "id", "left").join(risky, "id", "left")
    roles = F.array_sort(F.array_union("roles", F.coalesce("_more", none)))
    risk = F.when(F.col("_more").isNotNull() & F.col("_risky"), F.array(F.lit("wrong-layer-risk"))).otherwise(none)
    return got.withColumn("roles", roles).withColumn("risks", F.array_sort(F.array_union("risks", risk))).drop("_more", "_risky")


def invariants(entries: DataFrame) -> DataFrame:
    """(invariant, checked, violated): how many entries each rule speaks of, and how many break it.

    `entries` has roles, uncertainty, evidence (a count), guidance, warnings (a count).
    """
    t, g = F.col("uncertainty"), F.col("guidance")
    made = F.array_contains("roles", "generated-file")
    rules = (
        ("certain-has-evidence", t == "certain", F.col("evidence") > 0), ("unknown-is-uncertain", t == "unknown", g == "uncertain"),
        ("generated-is-not-edited", made, g == "generated-do-not-edit"), ("doubt-carries-a-warning", t.isin("possible", "unknown"), F.col("warnings") > 0),
    )
    cells = [F.struct(F.lit(name).alias("invariant"), when.alias("applies"), (when & ~F.coalesce(holds, F.lit(False))).alias("breaks")) for name, when, holds in rules]
    one = entries.select(F.explode(F.array(*cells)).alias("c"))
    return one.groupBy(F.col("c.invariant").alias("invariant")).agg(F.count_if("c.applies").alias("checked"), F.count_if("c.breaks").alias("violated"))


def field_selector(fields: DataFrame, selectors: DataFrame, most: int = 20) -> DataFrame:
    """(selector, status, entity, field, candidates) of selectors as `Entity.field`, `Entity`, or an id.

    `fields` has id, entity, field (null for the entity itself). An exact id counts before names. found, ambiguous with
    the first `most` candidate ids in order and their number, or not-found.
    """
    ask = selectors.select("selector").filter(F.trim("selector") != "").distinct()
    exact = ask.join(fields.select(F.col("id").alias("selector"), F.col("id").alias("hit")), "selector").withColumn("tier", F.lit(0))
    name = fields.select(F.concat_ws(".", "entity", "field").alias("selector"), F.col("id").alias("hit"))
    named = ask.join(name, "selector").withColumn("tier", F.lit(1))
    every = exact.unionByName(named).distinct()
    best = every.groupBy("selector").agg(F.min("tier").alias("tier"))
    hit = every.join(best, ["selector", "tier"])
    n = hit.groupBy("selector").agg(F.count("*").alias("n"), F.min("hit").alias("id"))
    # of each selector the first few ids: a rank within salts, then of what is left
    salted = hit.select("selector", "hit", F.pmod(F.xxhash64("hit"), F.lit(64)).alias("s"))
    few = _first(_first(salted, ["selector", "s"], most), ["selector"], most)
    listed = few.groupBy("selector").agg(F.array_sort(F.collect_list("hit")).alias("candidates"))
    got = ask.join(n, "selector", "left").join(listed, "selector", "left").join(fields.select("id", "entity", "field").distinct(), "id", "left")
    status = F.when(F.col("n").isNull(), "not-found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    sure = F.col("n") == 1
    return got.select("selector", status.alias("status"), F.when(sure, F.col("entity")).alias("entity"), F.when(sure, F.col("field")).alias("field"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")).distinct()


def _first(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("hit"))).filter(F.col("_n") <= most).drop("_n")
