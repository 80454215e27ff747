"""Ranking with adjustments, focus, boosts, allocation, packing and roll-ups for bounded evidence bundles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.functions.text import basename, dirname, is_docs_path, is_test_path
from weftline.session import partitions_for

# fixed values: margins, penalties and boosts
GENERIC_NAMES = r"(?i)^(readme(\.\w+)?|license(\.\w+)?|changelog(\.\w+)?|package\.json|package-lock\.json|tsconfig.*\.json|\.gitignore|\.npmignore)$"
GENERIC_PENALTY = -20
FOCUS_ABSOLUTE, FOCUS_RELATIVE, FOCUS_MEDIUM, NEAR_TIE = 8, 0.25, 4, 8
BOOSTS = {
    "architecture": {"focus_symbol": 500, "focus_file": 150, "changed_symbol": 5, "changed_file": 2, "owner_like": 60, "contract_like": 5, "adjacent": 25, "exact_query": 20, "closest_test": 0},
    "implementation": {"focus_symbol": 500, "focus_file": 150, "changed_symbol": 40, "changed_file": 15, "owner_like": 10, "contract_like": 45, "adjacent": 35, "exact_query": 10, "closest_test": 5},
    "test-implementation": {"focus_symbol": 500, "focus_file": 150, "changed_symbol": 300, "changed_file": 120, "owner_like": 5, "contract_like": 10, "adjacent": 15, "exact_query": 10, "closest_test": 50},
    "none": {"focus_symbol": 500, "focus_file": 150, "changed_symbol": 30, "changed_file": 10, "owner_like": 0, "contract_like": 0, "adjacent": 0, "exact_query": 0, "closest_test": 0},
}
OWNER_LIKE = r"(?i)(command|registry|dispatcher|adapter|analyzer|builder|producer|manager)"
CONTRACT_LIKE = r"(?i)(types?|schema|valid|constant|error)"


def adjusted(path: Column, score: Column, matched: Column, mode: str, guidance: Column, strongest_dir: Column) -> Column:
    """A score with the penalty of generic files and the adjustments of the mode."""
    out = score + F.when(basename(path).rlike(GENERIC_NAMES) & (matched < 2), GENERIC_PENALTY).otherwise(0)
    if mode == "feature-add":
        edit = F.when(guidance == "safe-primary-edit-target", 6).when(guidance == "inspect-before-edit", 3).otherwise(0)
        docs = F.when((guidance == "docs-only") | is_docs_path(path), -4).otherwise(0)
        test = F.when((guidance == "test-only") | is_test_path(path), 2).otherwise(0)
        return out + F.coalesce(edit, F.lit(0)) + F.coalesce(docs, F.lit(0)) + F.coalesce(test, F.lit(0))
    if mode == "subsystem":
        return out + F.when(dirname(path) == strongest_dir, 4).otherwise(0)
    return out


def retained(scored: DataFrame, order: list, cap: int) -> DataFrame:
    """Adds retained and drop_reason: the first `cap` rows of the order are retained, the tail is kept and marked.

    The cut is found by a top-k of the order's keys, so no task sorts all rows.
    """
    cut = scored.orderBy(*order).limit(cap).select("id", F.lit(True).alias("retained"))
    out = scored.join(cut, "id", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    return out.withColumn("drop_reason", F.when(~F.col("retained"), "over-cap"))


def focus(scored: DataFrame) -> DataFrame:
    """(id, score, runner_up, confidence) of the best candidate, judged by its lead."""
    top = scored.orderBy(F.desc("score"), "id").limit(2)
    w = Window.orderBy(F.desc("score"), "id")  # two rows
    best = top.withColumn("runner_up", F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    gap = F.col("score") - F.col("runner_up")
    wide = (gap >= FOCUS_ABSOLUTE) & ((F.col("runner_up") <= 0) | (gap / F.col("runner_up") >= FOCUS_RELATIVE))
    confidence = F.when(F.col("runner_up").isNull() | wide, "high").when(gap >= FOCUS_MEDIUM, "medium").otherwise("low")
    return best.select("id", "score", "runner_up", confidence.alias("confidence"))


def near_ties(scored: DataFrame, margin: int = NEAR_TIE) -> DataFrame:
    """(id, gap): candidates whose score is within the margin of the best one's; the best itself is left out."""
    best = scored.orderBy(F.desc("score"), "id").limit(1).select(F.struct("id", "score").alias("b")).scalar()
    gap = F.col("_b.score") - F.col("score")
    near = scored.withColumn("_b", best).filter((F.col("id") != F.col("_b.id")) & (F.abs(gap) <= margin))
    return near.select("id", gap.alias("gap"))


def boost(role: str, flags: dict[str, Column]) -> Column:
    """The sum of a role's boosts. Focus symbol excludes focus file, changed symbol excludes changed file."""
    b = BOOSTS[role]
    no = F.lit(False)
    f = lambda k: F.coalesce(flags.get(k, no), no)
    out = F.when(f("focus_symbol"), b["focus_symbol"]).when(f("focus_file"), b["focus_file"]).otherwise(0)
    out = out + F.when(f("changed_symbol"), b["changed_symbol"]).when(f("changed_file"), b["changed_file"]).otherwise(0)
    for k in ("owner_like", "contract_like", "adjacent", "exact_query", "closest_test"):
        out = out + F.when(f(k), b[k]).otherwise(0)
    return out


def allocate(groups: DataFrame) -> DataFrame:
    """(grp, available, granted): required-first allocation with spill-over.

    `groups` has grp, position, available, reservation, hard_limit: one row for each group of a bundle. Each group first
    takes min(available, reservation, hard_limit); what all reservations leave unused forms one pool, which is drained in
    order of position, each group up to its limit. The total never exceeds the sum of the reservations.
    """
    w = Window.orderBy("position")  # one row for each group of a bundle
    base = F.least("available", "reservation", "hard_limit")
    want = F.greatest(F.lit(0), F.least("available", "hard_limit") - base)
    rows = groups.withColumn("base", base).withColumn("want", want)
    pool = F.sum(F.col("reservation") - F.col("base")).over(Window.partitionBy())
    before = F.coalesce(F.sum("want").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("want"), pool - before))
    return rows.withColumn("granted", F.col("base") + extra).select("grp", "available", "granted")


def _in_order(rows: DataFrame, group: str, order: str, schema: str, start, step) -> DataFrame:
    """A fold over each group's rows in order: one pass over sorted partitions, holding one state and no group.

    `rows` has the group, the order, then the values. start() gives a group's state, step(state, values) what to emit;
    a state's rest() is emitted when the group ends. The sort is Spark's and spills.
    """
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, state = None, None
        arrow = to_arrow_schema(fields)
        for b in batches:
            out: list[tuple] = []
            for key, *values in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or key != present:
                    if state is not None:
                        out += [(present, *r) for r in state.rest()]
                    present, state = key, start()
                out += [(key, *r) for r in step(state, values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(names), arrow)], schema=arrow)
        if state is not None:
            rest = [(present, *r) for r in state.rest()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest) if rest else [[]] * len(names), arrow)], schema=arrow)

    parts = partitions_for(rows.sparkSession, rows)
    return rows.repartition(parts, group).sortWithinPartitions(group, order, *[c for c in rows.columns if c not in (group, order)]).mapInArrow(run, schema)


class _Packed:
    def __init__(self):
        self.used = self.n = 0

    def rest(self):
        return []


class _Kept:
    def __init__(self):
        self.ranges: list[list[int]] = []

    def rest(self):
        return [tuple(r) for r in self.ranges]


def pack(blocks: DataFrame, bundle: str, order: str, size: str, most_size: int, most_blocks: int) -> DataFrame:
    """(bundle, order, size, included): greedy packing in a fixed order; a block that does not fit is skipped.

    A fold over each bundle's blocks as they come, so a bundle may be of any size. Null sizes are taken as 0.
    """

    def step(state: _Packed, values: list) -> list[tuple]:
        at, s = values
        fits = state.used + s <= most_size and state.n < most_blocks
        if fits:
            state.used, state.n = state.used + s, state.n + 1
        return [(at, s, fits)]

    rows = blocks.select(bundle, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size))
    kinds = [blocks.schema[c].dataType.simpleString() for c in (bundle, order)]
    return _in_order(rows, bundle, order, f"`{bundle}` {kinds[0]}, `{order}` {kinds[1]}, `{size}` bigint, included boolean", _Packed, step)


def merge_in_order(ranges: DataFrame, group: str, order: str, start: str, end: str) -> DataFrame:
    """(group, start, end): line ranges merged as they arrive: each joins the first kept range it overlaps.

    The result depends on the order, so a group is one fold over its rows as they come; only the kept ranges of one
    group are held. Rows with a null are left out.
    """

    def step(state: _Kept, values: list) -> list[tuple]:
        _, a, b = values
        for r in state.ranges:
            if a <= r[1] and b >= r[0]:
                r[0], r[1] = min(a, r[0]), max(b, r[1])
                break
        else:
            state.ranges.append([a, b])
        return []

    clean = ranges.filter(F.col(group).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = clean.select(group, order, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    kind = ranges.schema[group].dataType.simpleString()
    return _in_order(rows, group, order, f"`{group}` {kind}, `{start}` bigint, `{end}` bigint", _Kept, step)


def merge_sorted(ranges: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end): the union of overlapping ranges, by windows alone."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def pass_rate(passed: Column, judged: Column) -> Column:
    """The share of passes among what was judged; null, not 0, where nothing was."""
    return F.count_if(passed) / F.nullif(F.count_if(judged), F.lit(0))


def verdict(blocked: Column, failed: Column) -> Column:
    """BLOCKED over REGRESSION over PASS."""
    return F.when(F.bool_or(blocked), "BLOCKED").when(F.bool_or(failed), "REGRESSION").otherwise("PASS")


def heading_order(found: Iterator[int]) -> bool:
    """Required headings stand in their order."""
    at = list(found)
    return all(a < b for a, b in zip(at, at[1:]))
