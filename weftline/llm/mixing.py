"""Mixing sources to target weights.

Every document has a fixed place on a hash line. Tokens are summed by source and hash bucket; the running sum over the
buckets shows in which bucket a source's budget ends. Only that boundary bucket is histogrammed again on the next bits
of the hash, level by level, until it is one place on the line. Documents below the threshold are taken, by a plain
filter: nothing is sorted, and a larger budget of the same source takes a superset of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import materialize

# bits of the place that each level looks at; the last one takes what is left of a bucket of a bucket, place by place
LEVEL_BITS = (12, 12, 24)
PLACE_BITS = sum(LEVEL_BITS)


def _place():
    """48 bits of hash, 0 to 2^48 - 1."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 64 - PLACE_BITS)


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, share, target, available, full, rest): whole passes and what is left for a partial pass.

    `target` is share of the weights times size_factor times the tokens of all documents; `full` passes use every
    document of the source; `rest` is 0 where the source is used up to its cap.
    """
    w = Window.partitionBy("mix")
    total = sizes.agg(F.sum("n_tokens").alias("total")).scalar()
    of_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    listed = targets.filter(F.col("mix").isNotNull() & F.col("source").isNotNull() & (F.col("weight") > 0)).distinct()
    want = listed.withColumn("share", F.col("weight") / F.sum("weight").over(w))
    want = want.withColumn("total", total).fillna(0, ["total"])
    goal = F.round(F.col("share") * F.col("size_factor") * F.col("total")).cast("long")
    cap = F.coalesce(F.col("max_repeats"), F.lit(1)).cast("long")
    passes = F.when(F.col("available") > 0, F.floor(F.col("target") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    return (
        want.withColumn("target", goal)
        .join(of_source, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("full", F.least(passes, cap))
        .withColumn("rest", F.when(F.col("full") < cap, F.col("target") - F.col("full") * F.col("available")).otherwise(0))
        .select("mix", "source", "share", "target", "available", "full", F.col("rest").cast("long").alias("rest"))
    )


def thresholds(spark: SparkSession, sizes: DataFrame, budget: DataFrame) -> DataFrame:
    """(mix, source, below): documents of the source with a place under `below` fill the rest of the budget.

    At the last level the boundary place is taken too if that comes nearer to the budget than leaving it.
    """
    open_ = budget.filter(F.col("rest") > 0).select("mix", "source", F.col("rest"), F.lit(0).cast("long").alias("prefix"))
    for level, bits in enumerate(LEVEL_BITS):
        shift = sum(LEVEL_BITS[level + 1 :])
        bucket = F.shiftright("place", shift)
        histogram = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        if level == 0:
            bars = open_.join(histogram, "source")
        else:  # only the boundary buckets are looked into
            edge = open_.select("source", "prefix").distinct()
            inner = (
                sizes.withColumn("prefix", F.shiftright("place", shift + bits))
                .join(edge, ["source", "prefix"])
                .groupBy("source", "prefix", bucket.alias("bucket"))
                .agg(F.sum("n_tokens").alias("tokens"))
            )
            bars = open_.join(inner, ["source", "prefix"])
        run = Window.partitionBy("mix", "source").orderBy("bucket")  # at most 2^12 rows each, at the last level the places of one part in 2^24
        upto = bars.withColumn("upto", F.sum("tokens").over(run)).withColumn("before", F.col("upto") - F.col("tokens"))
        boundary = upto.filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        edge_of = boundary.select("mix", "source", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"), "tokens")
        # a row for each mix and source, written so that no level is planned or run twice
        open_ = materialize(spark, edge_of if shift == 0 else edge_of.drop("tokens"), f"boundary{level}")
    nearer = F.col("tokens") - F.col("rest") < F.col("rest")
    return open_.select("mix", "source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("below"))


def mix_documents(spark: SparkSession, sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of all mixes.

    `sizes` has doc_id, source, n_tokens; `targets` has mix, source, weight, max_repeats, size_factor.
    documents: (mix, doc_id, source, n_tokens, repeats), repeats >= 1. shares: (mix, source, target_share,
    target_tokens, reached_tokens, reached_share, n_docs, most_repeats); reached_share is of the tokens of the mix.

    Defined results. Documents with a null or unlisted source count in the total, not in a mix. A source without
    documents, or one whose cap is too low, falls short; its part is not given to others. Rows of one doc_id are one
    place on the line and go together. A null max_repeats is 1; a weight that is null, zero or negative, or a null mix,
    takes no part. Documents of no tokens follow their place. Empty tables give no rows.
    """
    placed = sizes.withColumn("place", _place())
    budget = materialize(spark, budgets(placed, targets), "budget")
    cut = thresholds(spark, placed.filter(F.col("source").isNotNull()), budget)
    plan = materialize(spark, budget.join(cut, ["mix", "source"], "left"), "plan")
    extra = F.when(F.col("place") < F.col("below"), 1).otherwise(0)
    chosen = (
        placed.join(plan.select("mix", "source", "full", "below"), "source")
        .withColumn("repeats", (F.col("full") + F.coalesce(extra, F.lit(0))).cast("int"))
        .filter(F.col("repeats") > 0)
        .select("mix", "doc_id", "source", "n_tokens", "repeats")
    )
    reached = chosen.groupBy("mix", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached_tokens"), F.count("*").alias("n_docs"),
        F.max("repeats").alias("most_repeats"),
    )
    all_of_mix = F.sum(F.coalesce("reached_tokens", F.lit(0))).over(Window.partitionBy("mix"))
    got = F.coalesce("reached_tokens", F.lit(0))
    shares = plan.join(reached, ["mix", "source"], "left").select(
        "mix", "source", F.col("share").alias("target_share"), F.col("target").alias("target_tokens"),
        got.alias("reached_tokens"), F.when(all_of_mix > 0, got / all_of_mix).alias("reached_share"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return chosen, shares
