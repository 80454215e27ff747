"""Literal scans of texts, context windows, line slices and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import lines, literal_pieces

MATCH_CAP = 200


def matches(docs: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, line, column, line_text): every non-overlapping occurrence, counted from 1 in code points.

    Null texts have none; a null or empty needle is refused. Texts without the needle are dropped before they are cut.
    """
    if not needle:
        raise ValueError("an empty needle occurs everywhere")
    cut = docs.filter(F.col(text).contains(needle)).select(key, F.posexplode(lines(F.col(text))).alias("_i", "line_text"))
    pieces = cut.filter(F.col("line_text").contains(needle)).withColumn("_pieces", literal_pieces(F.col("line_text"), needle))
    # the column of occurrence k: all pieces up to it, and the needles between them
    at = F.transform(
        F.sequence(F.lit(1), F.size("_pieces") - 1),
        lambda k: F.aggregate(F.slice("_pieces", 1, k), F.lit(0), lambda a, x: a + F.length(x)) + (k - 1) * len(needle) + 1,
    )
    return pieces.select(key, (F.col("_i") + 1).alias("line"), F.explode(at).alias("column"), "line_text")


def capped(found: DataFrame, key: str, cap: int = MATCH_CAP) -> DataFrame:
    """The first `cap` matches in order of key, line and column, with the total and whether some were left out.

    The total comes from an aggregate and the rows from a top-k, so no task holds all matches.
    """
    total = found.agg(F.count("*").alias("total")).scalar()
    first = found.orderBy(key, "line", "column").limit(cap)
    return first.withColumn("total", total).withColumn("truncated", F.col("total") > cap)


def window_around(found: DataFrame, docs: DataFrame, key: str, text: str, before: int, after: int) -> DataFrame:
    """Adds the lines from `before` above to `after` below each match, clamped to the text."""
    all_lines = docs.select(key, lines(F.col(text)).alias("_lines"))
    lo = F.greatest(F.lit(1), F.col("line") - before)
    hi = F.least(F.size("_lines"), F.col("line") + after)
    return (
        found.join(all_lines, key)
        .withColumns({"from_line": lo, "to_line": hi})
        .withColumn("context", F.array_join(F.slice("_lines", F.col("from_line"), F.col("to_line") - F.col("from_line") + 1), "\n"))
        .drop("_lines")
    )


def match_kind(line: Column, column: Column) -> Column:
    """What a match is, from the text before it on its line: the first rule that fits."""
    head = F.regexp_replace(F.rtrim(F.substring(line, F.lit(1), column - 1)), r"[\"'`]$", "")
    head = F.rtrim(head)
    return (
        F.when(head.rlike(r"(===|!==|==|!=|<=|>=|<|>)$"), "usage")
        .when(head.rlike(r"[,(]$"), "usage")
        .when(head.rlike(r"\b(const|let|var|type)\b.*=$"), "declaration")
        .when(head.rlike(r"\w=$"), "usage")
        .when(head.rlike(r":$"), "declaration")
        .otherwise("unknown")
    )


def line_slice(docs: DataFrame, key: str, text: str, start: int, count: int) -> DataFrame:
    """(key, start_line, end_line, total_lines, slice): `count` lines from `start`, clamped at the end.

    A start past the end gives an empty slice whose end is before its start.
    """
    got = docs.filter(F.col(text).isNotNull()).select(key, lines(F.col(text)).alias("_l"))
    end = F.least(F.size("_l"), F.lit(start + count - 1))
    body = F.when(F.size("_l") >= start, F.array_join(F.slice("_l", start, count), "\n")).otherwise("")
    return got.select(key, F.lit(start).alias("start_line"), end.alias("end_line"), F.size("_l").alias("total_lines"), body.alias("slice"))


def cursor(end_line: Column, total: Column, known_end: Column) -> tuple[Column, Column]:
    """(next_line, reason) to go on after a slice; no next line where a known symbol is complete or the file ends.

    reason: eof, symbol-end-unknown, window-capped, or null for a complete symbol.
    """
    complete = known_end.isNotNull() & (end_line >= known_end)
    reason = F.when(complete, None).when(end_line + 1 > total, "eof").when(known_end.isNull(), "symbol-end-unknown").otherwise("window-capped")
    nxt = F.when(complete | (end_line + 1 > total), None).otherwise(end_line + 1)
    return nxt, reason


def page(df: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """Page `number` (from 0) of rows in total order. The pages before it bound what is sorted: a top-k, not a full sort."""
    top = df.orderBy(*order).limit(size * (number + 1))
    rank = F.row_number().over(Window.orderBy(*order))  # at most size * (number + 1) rows
    return top.withColumn("_n", rank).filter(F.col("_n") > size * number).drop("_n")
