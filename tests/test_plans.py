"""The shape of the plans that must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.functions import text as X
from weftline.operators import exact_scan, references, snapshot_diff, text_search
from weftline.operators.ordinals import KeyOrdinals
from weftline.plans import assembly_queries, change_queries, search_queries
from weftline.session import scratch, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"^[\s:+\-]*((?:Broadcast)?Exchange[^\n]*)", text, re.M)


def p1_pass(spark):
    """What p1_found runs before it stores its results."""
    store = KeyOrdinals(spark, scratch(spark, "plan"), 4)
    return snapshot_diff.changes_pass(spark, *change_queries._snapshots(spark, SF), store, **change_queries.NODES, with_values=False)


def test_scans_read_only_what_a_query_names(spark):
    text = plan(change_queries.p2_found(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and not any("evidence_refs" in s or "confidence" in s or "label" in s for s in schemas)
    text = plan(p1_pass(spark))
    assert "loaded_at" not in "".join(re.findall(r"ReadSchema: struct<[^\n]*", text))


def test_filters_reach_the_scan(spark):
    df = exact_scan.matches(table(spark, SF, "documents", "doc_id", "text"), "doc_id", "text", "retry")
    text = plan(df)
    assert "StringContains(text,retry)" in text and not exchanges(text)


def test_rows_of_snapshots_move_once(spark):
    text = plan(p1_pass(spark))
    wide = [e for e in exchanges(text) if "shuffleid" in e.lower() or "hashpartitioning(xxhash64" in e or "REPARTITION" in e]
    assert len(wide) == 1 and "CartesianProduct" not in text


def test_search_moves_reasons_once_and_ends_in_a_top_k(spark):
    text = plan(search_queries.search_relevance_documents(spark, SF))
    assert "TakeOrderedAndProject" in text and len(exchanges(text)) == 1 and "Python" not in text


@pytest.mark.parametrize("name", sorted(search_queries.QUERIES))
def test_no_cartesian_products(spark, name):
    text = plan(search_queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text


def test_pairs_of_a_hub_are_spread_and_not_moved(spark, tmp_path):
    """Two kinds give the same pair, rows are repeated and ends are null; the hub has 1100 owners and 1300 used nodes."""
    n = spark.range(1100 * 2).select((F.col("id") % 1100).cast("string").alias("k"), F.when(F.col("id") < 1100, "passes-prop").otherwise("derives-field").alias("kind"))
    m = spark.range(1300 * 2).select((F.col("id") % 1300).cast("string").alias("k"), F.lit("reads-field").alias("kind"))
    owns = n.select("kind", F.concat(F.lit("o"), "k").alias("source"), F.lit("hub").alias("target"))
    uses = m.select("kind", F.lit("hub").alias("source"), F.concat(F.lit("u"), "k").alias("target"))
    few = [("passes-prop", "a", "b"), ("renders-field", "b", "c"), ("reads-field", "b", "c"), ("renders-field", "b", None), ("relates-to", "x", "b"),
           ("passes-prop", None, "b"), ("derives-field", "a", "alone"), (None, "a", "b"), ("passes-prop", "o1", None), ("reads-field", None, "u")]
    owns.union(uses).union(spark.createDataFrame(few, "kind string, source string, target string")).write.parquet(str(tmp_path / "lineage_edges.parquet"))
    df = assembly_queries.usage_owner_pairs(spark, str(tmp_path))
    assert not any("owner#" in e and "used#" in e for e in exchanges(plan(df)))
    got = df.cache()
    assert got.count() == got.distinct().count() == 1100 * 1300 + 1
    assert [tuple(r) for r in got.filter("via <> 'hub'").collect()] == [("a", "b", "c")]
    per = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    got.unpersist()
    assert max(per) < 0.6 * sum(per)


def test_column_expressions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a/b",)], "p string").select(X.normalize(F.col("p")), X.encode_component(F.col("p")), X.shorten(F.col("p")))
    assert "Python" not in plan(df)


def test_modules_have_no_driver_side_rows():
    """No operator module gathers rows on the driver."""
    import inspect

    for module in (exact_scan, references, snapshot_diff, text_search):
        assert not re.search(r"\.(collect|toPandas|toLocalIterator)\(\)", inspect.getsource(module))
