"""Scans of source trees: every file with its state, content and hash, and the counters of a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import extension

# fixed values: folders that are never source, and the languages of extensions. A tool's own output folders are `excludes`
IGNORED_FOLDERS = ("node_modules", "target", ".next", "dist", "build", "coverage", "playwright-report", "test-results", "output", "out", ".cache", ".turbo", ".vercel", ".git", ".pytest_cache", "__pycache__", ".venv", "venv", ".gradle")
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".rs": "rust"}
SAMPLES, LARGEST = 20, 10


def language(path: Column) -> Column:
    """The language of an extension, null for others."""
    return F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[extension(path)]


def status(path: Column, excludes: Sequence[str] = ()) -> Column:
    """user-excluded, ignored-folder, declaration-file, unsupported or supported; the first that fits."""
    parts = F.split(path, "/")
    out = F.when(F.lit(False), "")
    for e in excludes:
        e = e.rstrip("/")
        out = out.when((path == e) | path.startswith(e + "/"), "user-excluded")
    return (
        out.when(F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in IGNORED_FOLDERS])), "ignored-folder")
        .when(path.rlike(r"\.d\.[cm]?ts$"), "declaration-file").when(language(path).isNull(), "unsupported").otherwise("supported")
    )


def ledger(files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    """Adds status, language, text and content_sha256 to (rel_path, content, size_bytes); bytes that are no UTF-8 are unreadable."""
    readable = F.is_valid_utf8("content")
    kind = status(F.col("rel_path"), excludes)
    return files.select(
        "rel_path", "size_bytes", F.when((kind == "supported") & ~readable, "unreadable").otherwise(kind).alias("status"),
        language(F.col("rel_path")).alias("language"), F.when(readable, F.col("content").cast("string")).alias("text"),
        F.sha2("content", 256).alias("content_sha256"),
    )


def scan(spark: SparkSession, root: str, excludes: Sequence[str] = ()) -> DataFrame:
    """The ledger of all files under a root. Listing and reading are spread by Spark's file source."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = F.regexp_replace(F.col("path"), "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    at = F.instr(where, F.lit(base))
    rel = F.when(at > 0, F.substring(where, at + len(base), F.length(where))).otherwise(where)
    return ledger(raw.select(rel.alias("rel_path"), "content", F.col("length").alias("size_bytes")), excludes)


def counters(led: DataFrame) -> DataFrame:
    """(status, files, bytes)."""
    return led.groupBy("status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def samples(led: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first paths of each status."""
    n = F.row_number().over(Window.partitionBy("status").orderBy("rel_path"))
    return led.select("status", "rel_path").withColumn("n", n).filter(F.col("n") <= most).drop("n")


def largest(led: DataFrame, most: int = LARGEST) -> DataFrame:
    return led.select("rel_path", "size_bytes").orderBy(F.desc("size_bytes"), "rel_path").limit(most)
