"""The pN_ queries of the problems on text corpora, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, parse_files, spans, tokenizer
from weftline.session import materialize, ship, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "source_files", "file_no", "repo", "path", "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_files.invalid_files(_files(spark, d))


def p5_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every fault of every file, its line and cause."""
    parsed = parse_files.parse_files(_files(spark, d)).filter(~F.col("accepted")).dropDuplicates(["file_no"])
    return parsed.select("file_no", F.posexplode("faults").alias("fault_no", "f")).select(
        "file_no", "fault_no", "f.line", "f.cause", (F.col("fault_no") == 0).alias("is_first")
    )


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_files.rates(_files(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return tokenizer.encode_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    sizes = tokenizer.count_tokens(table(spark, d, "documents", "doc_id", "source", "lang", "text"), "text")
    return sizes.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    sizes = tokenizer.count_tokens(table(spark, d, "documents", "doc_id", "source", "text"), "text")
    return mixing.mix_documents(spark, materialize(spark, sizes, "sizes"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return spans.shared_spans(spark, table(spark, d, "documents", "doc_id", "text"))


def p8_shared_parts(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    docs = table(spark, d, "documents", "doc_id", "text")
    return spans.shared_parts(docs, spans.shared_spans(spark, docs))


QUERIES = {f.__name__: f for f in (
    p5_found, p5_faults, p5_rates, p6_ids, p6_token_counts, p7_mixture, p7_shares, p8_found, p8_shared_parts,
)}

_SPANS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
w AS (SELECT doc_id, s, substr(text, s + 1, 200) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS s FROM d)),
k AS (SELECT x FROM w GROUP BY x HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, s FROM w WHERE x IN (SELECT x FROM k)),
m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM h),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM m),
spans AS (SELECT doc_id, min(s) AS span_start, max(s) + 200 - min(s) AS span_chars FROM i GROUP BY doc_id, run)
"""
SQL: dict[str, str] = {
    "p8_found": _SPANS + "SELECT doc_id, span_start, span_chars FROM spans",
    "p8_shared_parts": _SPANS + """
, t AS (SELECT doc_id, CAST(sum(span_chars) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS n_chars, coalesce(shared_chars, 0) AS shared_chars,
  CASE WHEN length(d.text) > 0 THEN coalesce(shared_chars, 0) / length(d.text) ELSE 0.0 END AS shared_share
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.text IS NOT NULL""",
}
