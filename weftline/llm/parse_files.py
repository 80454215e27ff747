"""Source files that are not valid in the language their path stands for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.syntax import java, kotlin, python, rust, script

# fixed values: extensions, in lower case, and the languages they stand for
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java",
    "kt": "kotlin", "rs": "rust",
}
OUT = "file_no bigint, accepted boolean, n_faults int, first_line int, first_cause string, faults array<struct<line:int,cause:string>>"


def extension() -> Column:
    return F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))


def language_of_path() -> Column:
    """The language of the path's extension, null where it stands for none."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return pairs[extension()]


def faults_of(extension: str, text: str) -> list[tuple[int, str]]:
    """All faults of one file: (offset, what)."""
    if extension == "py":
        return python.parse(text)
    if extension == "java":
        return java.parse(text)
    if extension == "kt":
        return kotlin.parse(text)
    if extension == "rs":
        return rust.parse(text)
    # .ts knows type assertions in angle brackets and so no elements
    return script.parse(text, extension in ("ts", "tsx"), extension != "ts")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file_no", pa.int64()), ("accepted", pa.bool_()), ("n_faults", pa.int32()), ("first_line", pa.int32()),
        ("first_cause", pa.string()), ("faults", pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))),
    ])
    for b in batches:
        rows: dict[str, list] = {n: [] for n in schema.names}
        for no, ext, text in zip(*(c.to_pylist() for c in b.columns)):
            found = faults_of(ext, text) if text else []
            shift = 1 if text and text.startswith("﻿") else 0
            lines = [{"line": text.count("\n", 0, at + shift) + 1, "cause": what} for at, what in found]
            first = lines[0] if lines else {"line": None, "cause": None}
            for n, v in zip(schema.names, (no, not lines, len(lines), first["line"], first["cause"], lines)):
                rows[n].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema)


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each row of `files` (file_no, path, content) whose path stands for a language; see OUT.

    faults holds every fault that panic-mode recovery met, in order; first_cause is the first.

    Defined results. Null and empty contents and those of comments only are accepted. A leading byte order mark is
    allowed. Extensions count in any letter case; other files, and null paths, are left out. Repeated rows give
    repeated results. Other columns are not read. No depth of nesting and no number of faults is too much.
    """
    return files.filter(language_of_path().isNotNull()).select("file_no", extension().alias("ext"), "content").mapInArrow(_parse, OUT)


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_no): each file that is not accepted, once."""
    return parse_files(files).filter(~F.col("accepted")).select("file_no").distinct()


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, invalid_rate) of the files whose path stands for a language."""
    verdicts = parse_files(files.select("file_no", "path", "content")).groupBy("file_no").agg(F.min("accepted").alias("accepted"))
    known = files.select("file_no", "repo", language_of_path().alias("language")).filter(F.col("language").isNotNull()).distinct()
    bad = F.count_if(~F.col("accepted"))
    return (
        known.join(verdicts, "file_no").groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), (bad / F.count("*")).alias("invalid_rate"))
    )
