"""Source bundles and evidence capsules: what a reader of a change needs, within stated limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import lines
from weftline.session import materialize

# fixed values: limits of a bundle and of a capsule
MOST_LINES, MOST_BLOCKS = 300, 20
SLICES, SLICE_LINES = 8, 160
PREVIEW_LINES = 20


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line): a text's lines with right-aligned numbers, as `  12 | code`."""
    one = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(lines(F.col(text))).alias("i", "l"))
    return one.select(key, (F.col("i") + 1).alias("n"), F.concat(F.lpad((F.col("i") + 1).cast("string"), 4, " "), F.lit(" | "), F.col("l")).alias("line"))


def block_text(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text; an unknown end gives a short preview."""
    last = F.coalesce(end, start + (PREVIEW_LINES - 1))
    return F.array_join(F.slice(lines(text), start, F.greatest(F.lit(1), last - start + 1)), "\n")


def bundles(symbols: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """(keys, primary, primary_line, name, line, lines, included): for each top-level symbol of a file the others its text mentions.

    `symbols` has the keys, name, line, end_line; `files` the keys and content. A block is a declaration: one name may
    have many (overloads, a type and its impls), each is a primary, and a mention brings all of them; those that begin on
    one line are one block, to the last end. The primary block comes first, then the mentioned ones by line; blocks are
    packed greedily within MOST_LINES and MOST_BLOCKS, and what does not fit is kept and marked. A mention is the name as
    a whole word.
    """
    top = symbols.groupBy(*key, "name", "line").agg(F.max("end_line").alias("end_line"))
    text = files.select(*key, "content").distinct()
    size = F.coalesce(F.col("end_line"), F.col("line") + (PREVIEW_LINES - 1)) - F.col("line") + 1
    primary = top.join(text, key).select(
        *key, F.col("name").alias("primary"), F.col("line").alias("primary_line"), block_text(F.col("content"), F.col("line"), F.col("end_line")).alias("body")
    )
    words = F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1)))
    said = primary.select(*key, "primary", "primary_line", F.explode(F.array_union(F.array("primary"), words)).alias("name"))
    blocks = said.join(top, [*key, "name"]).select(*key, "primary", "primary_line", "name", "line", size.alias("lines"))
    first = F.when((F.col("name") == F.col("primary")) & (F.col("line") == F.col("primary_line")), 0).otherwise(1)
    order = F.struct(first.alias("f"), F.col("line").alias("l"), F.col("name").alias("name"))
    cells = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("lines").cast("long").alias("s"))))
    zero = F.struct(
        F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"),
        F.array().cast("array<struct<name:string,line:int,lines:bigint,included:boolean>>").alias("out"),
    )

    def step(acc, b):
        fits = (acc["used"] + b["s"] <= MOST_LINES) & (acc["n"] < MOST_BLOCKS)
        one = F.struct(b["o"]["name"].alias("name"), b["o"]["l"].alias("line"), b["s"].alias("lines"), fits.alias("included"))
        return F.struct(
            (acc["used"] + F.when(fits, b["s"]).otherwise(0)).alias("used"), (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"),
            F.concat(acc["out"], F.array(one)).alias("out"),
        )

    packed = blocks.groupBy(*key, "primary", "primary_line").agg(F.aggregate(cells, zero, step)["out"].alias("out"))
    one = packed.select(*key, "primary", "primary_line", F.explode("out").alias("_b"))
    return one.select(*key, "primary", "primary_line", "_b.name", "_b.line", "_b.lines", "_b.included")


def capsule(ranked: DataFrame, docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(rank, key, path, score, end_line, truncated, next_line, slice): evidence of the best candidates, as one bounded table.

    `ranked` holds few rows (a top-k) with id, score and rank; each gives its first SLICE_LINES lines, with a
    continuation where the text goes on.
    """
    top = ranked.filter(F.col("rank") <= SLICES)
    got = docs.join(F.broadcast(top), docs[key] == top["id"])  # at most SLICES rows
    l = lines(F.coalesce(F.col(text), F.lit("")))
    end = F.least(F.size(l), F.lit(SLICE_LINES))
    more = F.size(l) > SLICE_LINES
    return got.select(
        "rank", F.col(key), F.col(path).alias("path"), "score", end.alias("end_line"), more.alias("truncated"),
        F.when(more, end + 1).alias("next_line"), F.array_join(F.slice(l, 1, SLICE_LINES), "\n").alias("slice"),
    )


def mounts(spark: SparkSession, routes: DataFrame, joins: DataFrame) -> DataFrame:
    """(scope, method, path): full paths of routes through the routers that mount them.

    `routes` has scope, router, method, path; `joins` scope, router (the one that mounts), prefix, child. A router that
    nothing mounts is a root. Mounting is followed to the roots at any depth; a router that is reached again on its own
    way is not followed further, so routers that mount each other end there.
    """
    parents = joins.select("scope", F.col("child").alias("router"), F.col("router").alias("up"), "prefix").distinct()
    mounted = parents.select("scope", "router").distinct()
    level = routes.select("scope", "router", "method", "path", F.array("router").alias("way")).distinct()
    done = []
    while True:
        level = materialize(spark, level, "mounts")
        done.append(level.join(mounted, ["scope", "router"], "left_anti").select("scope", "method", "path"))
        full = F.regexp_replace(F.concat_ws("/", "prefix", "path"), "/+", "/")
        up = level.join(parents, ["scope", "router"]).filter(~F.array_contains("way", F.col("up")))
        level = up.select("scope", F.col("up").alias("router"), "method", full.alias("path"), F.array_append("way", F.col("up")).alias("way")).distinct()
        if level.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.distinct()


def module_files(declarations: DataFrame, inventory: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path, name, status, target): the file of each `mod name;` of a Rust file.

    Beside main.rs, lib.rs and mod.rs it is name.rs or name/mod.rs, else those under the file's own name. Both at once
    are ambiguous.
    """
    folder = F.regexp_replace("path", r"[^/]*$", "")
    stem = F.regexp_replace("path", r"\.rs$", "/")
    base = F.when(F.col("path").rlike(r"(^|/)(main|lib|mod)\.rs$"), folder).otherwise(stem)
    tried = declarations.select(*scope, "path", "name").distinct().withColumn("base", base)
    each = tried.select(*scope, "path", "name", F.explode(F.array(F.concat("base", "name", F.lit(".rs")), F.concat("base", "name", F.lit("/mod.rs")))).alias("target"))
    there = inventory.select(*scope, F.col("path").alias("target")).distinct()
    hit = each.join(there, [*scope, "target"]).groupBy(*scope, "path", "name").agg(F.count("*").alias("n"), F.min("target").alias("t"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return tried.drop("base").join(hit, [*scope, "path", "name"], "left").select(
        *scope, "path", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("t")).alias("target")
    )


def evaluate(expectations: DataFrame, results: DataFrame) -> DataFrame:
    """(suite, task, category, id, passed): expectations (suite, task, category, id, top_k) against ranked results (task, id, rank).

    category forbidden: the id is not among the first top_k, or not at all where top_k is null; at-most: the task has no
    more than top_k results; any other: the id is among the first top_k.
    """
    many = results.groupBy("task").agg(F.count("*").alias("_n"))
    got = expectations.join(results, ["task", "id"], "left").join(many, "task", "left")
    there = F.coalesce(F.col("rank") <= F.coalesce("top_k", F.col("rank")), F.lit(False))
    passed = F.when(F.col("category") == "forbidden", ~there).when(F.col("category") == "at-most", F.coalesce("_n", F.lit(0)) <= F.col("top_k")).otherwise(there)
    return got.select("suite", "task", "category", "id", passed.alias("passed"))
