"""Differences of keyed tables, of flat records and of bags, and incremental merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed_fields, before, after) of records that differ; one full outer join on the key.

    change: added, removed or changed. changed_fields are sorted names; before and after are structs of all fields, null
    on the missing side. Two nulls are equal, null differs from any value. Keys are taken as unique; null keys are left
    out.
    """
    b = before.filter(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("before"))
    a = after.filter(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("after"))
    both = b.join(a, key, "full_outer")
    differ = F.array_sort(F.filter(F.array(*[
        F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields
    ]), lambda x: x.isNotNull()))
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.size("fields") > 0, "changed")
    )
    return (
        both.withColumn("fields", differ).withColumn("change", change).filter(F.col("change").isNotNull())
        .select(key, "change", F.when(F.col("change") == "changed", F.col("fields")).alias("changed_fields"), "before", "after")
    )


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def change_classes(before: DataFrame, after: DataFrame, key: str, content_hash: str) -> DataFrame:
    """(key, class) of every key: added, removed, changed or unchanged, by content hash; a null hash is never unchanged."""
    b = before.select(key, F.col(content_hash).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(key, F.col(content_hash).alias("_a"), F.lit(True).alias("_in_a"))
    got = b.join(a, key, "full_outer")
    kind = (
        F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed")
        .when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    )
    return got.select(key, kind.alias("class"))


def flat_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(field, before, after) of the fields in which two one-row records differ."""

    def unpivot(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in df.columns])
        return df.select(F.explode(cells).alias("c")).select("c.field", F.col("c.v").alias(name))

    both = unpivot(before, "before").join(unpivot(after, "after"), "field", "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def bag_diff(before: DataFrame, after: DataFrame, group: list[str], pair: str, identity: str) -> DataFrame:
    """(identity, change) of records as bags.

    Records of equal identity on both sides cancel. Of the rest, groups of equal multiplicity on both sides cancel.
    What is left is paired by `pair` only where one record stands on each side (`changed`, once for each side's record),
    else it is added or removed. Three windows over one union of both sides: each record is read once.
    """
    side = before.select(F.lit("b").alias("side"), identity, pair, *group).unionByName(after.select(F.lit("a").alias("side"), identity, pair, *group))

    def both(*keys: str) -> tuple[Column, Column]:
        w = Window.partitionBy(*keys)
        return F.count_if(F.col("side") == "b").over(w), F.count_if(F.col("side") == "a").over(w)

    b, a = both(identity)
    rest = side.withColumns({"_nb": b, "_na": a}).filter((F.col("_nb") == 0) | (F.col("_na") == 0))
    b, a = both(*group)
    left = rest.withColumns({"_nb": b, "_na": a}).filter(F.col("_nb") != F.col("_na"))
    b, a = both(pair)
    paired = left.withColumns({"_nb": b, "_na": a})
    one = (F.col("_nb") == 1) & (F.col("_na") == 1)
    change = F.when(one, "changed").when(F.col("side") == "a", "added").otherwise("removed")
    return paired.select(identity, change.alias("change"))


def provenance(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, origin): which of two sets a key comes from, or both."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    both = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), names[0]).otherwise(names[1])
    return a.join(b, key, "full_outer").select(key, both.alias("origin"))


def reuse_merge(old: DataFrame, fresh: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Old rows of keys that are neither fresh nor removed, and all fresh rows: a partial rebuild."""
    gone = fresh.select(key).unionByName(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(fresh)


def fingerprint(settings: dict[str, Column | str]) -> Column:
    """A hash of named settings, independent of their order."""
    cells = [F.concat(F.lit(k + "="), v if isinstance(v, Column) else F.lit(v)) for k, v in sorted(settings.items())]
    return F.sha2(F.concat_ws("\n", *cells), 256)


SALTS = 64


def marked_first(rows: DataFrame, key: str, order: str, most: int, total: str) -> DataFrame:
    """Rows with `total`, the number of rows of their key, and `listed`: whether a row is among the first `most` of it.

    No row is dropped. A key may have most of all rows: the last listed place is found within SALTS parts first, so no
    task sorts a key's rows, and the counts are combined before they move. (key, order) is unique.
    """
    part = rows.select(key, order).withColumn("_s", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    few = part.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_s").orderBy(order))).filter(F.col("_n") <= most)
    last = few.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= most)
    upto = last.groupBy(key).agg(F.max(order).alias("_upto"))
    per = rows.groupBy(key).agg(F.count("*").alias(total)).join(upto, key)
    return rows.join(per, key).withColumn("listed", F.col(order) <= F.col("_upto")).drop("_upto")
