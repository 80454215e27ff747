"""From observations in files to a graph of how model fields become view models, properties and rendered fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import rules

NODE = ("id", "kind", "label", "confidence", "entity", "field", "evidence")


def _id(kind: str, *more: Column) -> Column:
    return F.concat(F.lit(f"lineage:{kind}:"), *more)


def _in_file(kind: str, scope: Column, name: Column | None = None) -> Column:
    tail = [F.lit("."), name] if name is not None else []
    return _id(kind, F.col("path"), F.lit("#"), scope, *tail)


def models_of(facts: DataFrame) -> DataFrame:
    """(entity, field): fields of the models whose name exactly one declaration has."""
    ent = facts.filter((F.col("record") == "model") & F.col("kind").isin("interface", "type")).select("path", "name").distinct()
    one = ent.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    fields = facts.filter(F.col("record") == "model_field").select("path", F.col("owner").alias("name"), F.col("name").alias("field")).distinct()
    return fields.join(one.drop("n"), ["path", "name"]).select(F.col("name").alias("entity"), "field")


def build(facts: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the lineage: see NODE; edges (id, kind, source, target, confidence, evidence).

    `facts` has path and the fields of a fact (record `lineage`); `models` entity and field. An observation whose type or
    field is no known one is dropped. Several observations of a node or edge are one, with the higher confidence and all
    evidence. Tables of models may be of any size: every step is an equi-join on path and name, or on entity and field.
    """
    f = facts.filter(F.col("record") == "lineage").select("path", "kind", "name", "line", "owner", "detail").distinct()
    at = F.array(F.concat(F.col("path"), F.lit(":"), F.col("line"))).alias("evidence")
    of = lambda kind: f.filter(F.col("kind") == kind)
    split = lambda c: (F.substring_index(c, ".", 1), F.substring_index(c, ".", -1))
    field_node = _id("data-field", F.col("entity"), F.lit("."), F.col("field"))
    known = models.select("entity", "field").distinct()

    entity, field = split("name")
    outputs = of("output").select("path", "owner", "detail", entity.alias("entity"), field.alias("field"), at).join(known, ["entity", "field"])
    outputs = outputs.withColumn("origin", field_node).withColumn("view", _in_file("view-model", F.col("owner"), F.col("detail")))
    alias = of("alias").select("path", F.col("owner").alias("base"), F.col("name").alias("entity")).distinct()
    objects = of("object").select("path", "owner", "detail", split("name")[0].alias("base"), split("name")[1].alias("field"), at)
    objects = objects.join(alias, ["path", "base"]).join(known, ["entity", "field"]).withColumn("origin", field_node)
    derived = of("derived").select("path", F.col("owner").alias("variable"), F.col("name").alias("owner"), at.alias("seen"))
    through = derived.join(outputs, ["path", "owner"]).select("path", F.col("variable").alias("owner"), "detail", "entity", "field", F.col("seen").alias("evidence"), F.col("view").alias("origin"))
    held = objects.select("path", "owner", "detail", "entity", "field", "evidence", "origin").unionByName(through).withColumn("view", _in_file("view-model", F.col("owner"), F.col("detail")))
    passed = of("pass").select("path", "owner", "detail", split("name")[0].alias("base"), split("name")[1].alias("member"), at)
    direct = passed.withColumnRenamed("member", "field").join(alias, ["path", "base"]).join(known, ["entity", "field"]).withColumn("origin", field_node)
    viewed = passed.join(held.select("path", F.col("owner").alias("base"), F.col("detail").alias("member"), "entity", "field", F.col("view").alias("origin")), ["path", "base", "member"])
    cells = ["path", "owner", "detail", "entity", "field", "evidence", "origin"]
    passes = direct.select(*cells).unionByName(viewed.select(*cells)).withColumn("prop", _in_file("component-prop", F.col("owner"), F.col("detail")))
    shown = of("rendered").select("path", "owner", F.col("name").alias("detail"), at).withColumn("prop", _in_file("component-prop", F.col("owner"), F.col("detail"))).withColumn("view", _in_file("rendered-field", F.col("owner"), F.col("detail")))

    none = F.lit(None).cast("string")

    def nodes_of(df: DataFrame, id_: Column, kind: str, label: Column, sure: str = "explicit", model: bool = True) -> DataFrame:
        e, x = (F.col("entity"), F.col("field")) if model else (none, none)
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(sure).alias("confidence"), e.alias("entity"), x.alias("field"), "evidence")

    def edges_of(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
        return df.select(F.concat(F.lit(f"lineage-edge:{kind}:"), source, F.lit("->"), target).alias("id"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), F.lit("explicit").alias("confidence"), "evidence")

    both = F.concat_ws(".", "owner", "detail")
    blank = F.array().cast("array<string>").alias("evidence")
    base = known.select("entity", "field", blank)
    step = _in_file("transformation", F.col("owner"))
    used = of("used").select("path", "owner", at)
    nodes = [
        nodes_of(base, _id("data-entity", F.col("entity")), "data-entity", F.col("entity")).withColumn("field", none),
        nodes_of(base, field_node, "data-field", F.concat_ws(".", "entity", "field")),
        nodes_of(outputs, step, "transformation", F.col("owner"), model=False),
        nodes_of(outputs, F.col("view"), "view-model", both), nodes_of(held, F.col("view"), "view-model", both),
        nodes_of(of("component").select("path", "owner", at), _in_file("component", F.col("owner")), "component", F.col("owner"), model=False),
        nodes_of(used, _in_file("component", F.col("owner")), "component", F.col("owner"), "partial", False),
        nodes_of(shown, F.col("prop"), "component-prop", both, model=False), nodes_of(shown, F.col("view"), "rendered-field", both, model=False),
        nodes_of(passes, F.col("prop"), "component-prop", both),
    ]
    edges = [
        edges_of(outputs, "reads-field", F.col("origin"), step), edges_of(outputs, "creates-view-model", step, F.col("view")),
        edges_of(held, "derives-field", F.col("origin"), F.col("view")), edges_of(passes, "passes-prop", F.col("origin"), F.col("prop")),
        edges_of(shown, "renders-field", F.col("prop"), F.col("view")),
    ]

    def merged(parts: list[DataFrame], scalars: list[str]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return rules.upsert(out.withColumn("_o", F.array_join("evidence", ",")), "id", "_o", scalars, "confidence", rules.LINEAGE_LEVELS, "evidence")

    n = merged(nodes, ["kind", "label", "entity", "field"]).select(*NODE)
    return n, merged(edges, ["kind", "source", "target"]).select("id", "kind", "source", "target", "confidence", "evidence")
