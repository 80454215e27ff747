"""Evidence groups of a context, responsibilities mapped onto them, and requests merged from two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import basename, is_test_path
from weftline.operators.context import CONTRACT_LIKE, OWNER_LIKE

# fixed values: name patterns of evidence, and how many responsibilities are mapped
VALIDATOR, CONSTANT, ERROR, SCHEMA = r"(?i)valid", r"(?i)constant", r"(?i)error", r"(?i)schema"
SIDE_EFFECT = r"(?i)(fs|filesystem|process|exec|spawn|network|http|client|writer|persist|cleanup)"
MOCK, FACTORY, SETUP, FIXTURE = r"(?i)(mock|stub|fake|spy)", r"(?i)(factory|builder|createtest|maketest)", r"(?i)(setup|globalsetup|testsetup)", r"(?i)fixture"
MOST_RESPONSIBILITIES = 25
SALTS = 64


def group_kinds(path: Column, label: Column) -> Column:
    """The groups that an item belongs to, by its path and label."""
    base, test = basename(path), is_test_path(path)
    text = F.concat_ws(" ", base, label)
    rules = (
        ("owners", base.rlike(OWNER_LIKE) & ~test), ("contracts", base.rlike(CONTRACT_LIKE) & ~test), ("validators-and-constants", (text.rlike(VALIDATOR) | text.rlike(CONSTANT)) & ~test),
        ("errors", text.rlike(ERROR) & ~test), ("schemas-and-serializers", text.rlike(SCHEMA) & ~test), ("errors-and-side-effects", (text.rlike(ERROR) | text.rlike(SIDE_EFFECT)) & ~test),
        ("related-tests", test), ("mocks", test & base.rlike(MOCK)), ("factories", test & base.rlike(FACTORY)), ("fixtures", test & path.rlike(FIXTURE)), ("setup-and-configuration", test & base.rlike(SETUP)),
    )
    return F.filter(F.array(*[F.when(test_, name) for name, test_ in rules]), lambda x: x.isNotNull())


def evidence_groups(items: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, summary) of ranked items in named groups.

    `items` has grp, id, score, path; `limits` grp, most. Of the rows of one id in a group the best counts. selected:
    (grp, id, score, path, rank), the first `most` by score, path and id; summary: (grp, available, selected, dropped)
    of every group of `limits`. A group may hold most of all items: it is ranked within SALTS parts first, and only the
    best `most` of each part meet in one task.
    """
    best = items.filter(F.col("grp").isNotNull() & F.col("id").isNotNull()).groupBy("grp", "id").agg(F.max("score").alias("score"), F.min("path").alias("path"))
    known = best.join(limits.select("grp", "most").distinct(), "grp")
    order = [F.desc("score"), F.asc_nulls_last("path"), "id"]
    part = known.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = part.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "_s").orderBy(*order))).filter("_n <= most")
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter("rank <= most")
    have = best.groupBy("grp").agg(F.count("*").alias("available"))
    summary = limits.select("grp", "most").distinct().join(have, "grp", "left").select("grp", F.coalesce("available", F.lit(0)).alias("available"), F.least(F.coalesce("available", F.lit(0)), F.col("most")).alias("selected"))
    return chosen.select("grp", "id", "score", "path", "rank"), summary.withColumn("dropped", F.col("available") - F.col("selected"))


def responsibilities(asked: DataFrame, evidence: DataFrame, commands_required: bool = False, most: int = MOST_RESPONSIBILITIES) -> DataFrame:
    """(scope, responsibility, status, missing, retained) of what each scope was asked to show.

    `asked` has scope, responsibility, position, critical; `evidence` scope, grp and category (one of production,
    contract, test, oracle, command): what the scope's groups hold. mapped: all categories are there; unmapped: none;
    else partially-mapped. Of a repeated responsibility the first position counts. Beyond `most` of a scope, critical
    ones first and then in order of name, the rest is kept and marked as not retained.
    """
    need = ["production", "contract", "test", "oracle"] + (["command"] if commands_required else [])
    has = evidence.groupBy("scope").agg(F.collect_set("category").alias("_has"))
    one = asked.filter(F.col("responsibility").isNotNull()).groupBy("scope", "responsibility").agg(F.min("position").alias("position"), F.min_by("critical", "position").alias("critical"))
    got = one.join(has, "scope", "left").withColumn("_has", F.coalesce("_has", F.array().cast("array<string>")))
    missing = F.array_except(F.array(*[F.lit(x) for x in need]), F.col("_has"))
    status = F.when(F.size(missing) == 0, "mapped").when(F.size(missing) == len(need), "unmapped").otherwise("partially-mapped")
    order = Window.partitionBy("scope").orderBy(F.desc(F.coalesce("critical", F.lit(False))), "responsibility")
    return got.select("scope", "responsibility", "position", status.alias("status"), F.array_join(missing, ",").alias("missing"), (F.row_number().over(order) <= most).alias("retained"))


def merge_request(given: dict, explicit: set[str], stored: dict, defaults: dict) -> dict[str, tuple[object, str]]:
    """One request from what a caller gives and what a file says: field -> (value, source).

    A stored field holds unless the caller gives another value for it: that is a conflict. Texts are compared without
    regard to case and white space, lists without regard to order and repeats.
    """

    def same(a, b) -> bool:
        if isinstance(a, str) and isinstance(b, str):
            return " ".join(a.lower().split()) == " ".join(b.lower().split())
        if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
            return sorted(set(map(str, a))) == sorted(set(map(str, b)))
        return a == b

    out: dict[str, tuple[object, str]] = {}
    for field in [*defaults, *(f for f in (*given, *stored) if f not in defaults)]:
        if field in out:
            continue
        mine, file = given.get(field), stored.get(field)
        chosen = field in explicit and mine is not None
        if file is None:
            out[field] = (mine if mine is not None else defaults.get(field), "caller" if chosen else "default")
        elif not chosen:
            out[field] = (file, "request-file")
        elif same(mine, file):
            out[field] = (mine, "equivalent-duplicate")
        else:
            raise ValueError(f"conflicting {field}: {mine!r} and, in the request file, {file!r}")
    return out
