"""Deeply nested audit reports as flat, linked tables.

One pass builds a structural index of each batch of texts and emits the rows of every child table, each with the links
(root number, file position, item position) to its parents. Reports are cut into slices of bounded bytes, so memory does
not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.structural import OPEN_O, SCALAR, STR, StructuralIndex

SLICE_BYTES = 4 << 20
COLUMNS = ("record_kind", "root_no", "file_pos", "item_pos", "name", "value", "path", "language", "role", "status", "content_sha256")
OUT = "record_kind string, root_no bigint, file_pos int, item_pos int, name string, value string, path string, language string, role string, status string, content_sha256 string"


def decimal_text(x: str | None) -> str | None:
    """A whole number in plain decimal digits; any other text as it stands."""
    if x is None or x.lstrip("-").isdigit():
        return x
    try:
        d = Decimal(x)
        return str(int(d)) if d == d.to_integral_value() else x
    except (InvalidOperation, ValueError, OverflowError):
        return x


def _shred(roots: list[int], texts: list[bytes], wanted: frozenset) -> Iterator[dict]:
    s = StructuralIndex(texts)
    rows: dict[str, list] = {c: [] for c in COLUMNS}

    def put(kind, n, **cells):
        for c in COLUMNS:
            rows[c].extend(cells.get(c) if c in cells else [kind] * n if c == "record_kind" else [None] * n)

    doc_no = np.array(roots, object)  # a null number stays null
    _, lists = s.child(s.roots(), "files")
    _, files = s.elements(lists)
    root, fpos = doc_no[s.doc[files]], s.pos[files]
    where = np.full(s.kind.size, -1, np.int64)
    where[files] = np.arange(files.size)

    def field(parents: np.ndarray, key: str) -> list:
        out: list = [None] * parents.size
        at = np.full(s.kind.size, -1, np.int64)
        at[parents] = np.arange(parents.size)
        p, c = s.child(parents, key)
        for i, v in zip(at[p].tolist(), c.tolist()):
            out[i] = s.text(v)
        return out

    if "file" in wanted:
        put("file", files.size, root_no=root.tolist(), file_pos=fpos.tolist(), item_pos=[-1] * files.size,
            path=field(files, "path"), language=field(files, "language"), role=field(files, "role"),
            status=field(files, "status"), content_sha256=field(files, "contentSha256"))
    names = {v: k for k, v in s.keys.items()}
    p, caps = s.child(files, "capabilities")
    holder, members = s.members(caps)
    if "declarations" in wanted and "capability" not in wanted and members.size:
        only = s.key[members] == s.keys.get("declarations", -2)
        holder, members = holder[only], members[only]
    owner = where[s.parent[holder]]
    value: list = [None] * members.size
    for i in np.flatnonzero(s.kind[members] == STR).tolist():
        value[i] = s.text(members[i])
    objects = np.flatnonzero(s.kind[members] == OPEN_O)
    at = {int(members[i]): int(i) for i in objects}
    for q, c in zip(*(x.tolist() for x in s.child(members[objects], "status"))):
        if s.kind[c] == STR:
            value[at[q]] = s.text(c)
    put("capability", members.size, root_no=root[owner].tolist(), file_pos=fpos[owner].tolist(),
        item_pos=[-1] * members.size, name=[names[k] for k in s.key[members].tolist()], value=value)

    _, held = s.child(files, "facts")
    single = held[s.kind[held] == OPEN_O]
    _, many = s.elements(held)
    facts = np.concatenate([many, single])
    of_file = np.concatenate([where[s.parent[s.parent[many]]], where[s.parent[single]]]).astype(np.int64)
    item = np.concatenate([s.pos[many], np.zeros(single.size, np.int64)])
    lines: list = [None] * facts.size
    slot = np.full(s.kind.size, -1, np.int64)
    slot[facts] = np.arange(facts.size)
    span_of, spans = s.child(facts, "span")
    up = np.full(s.kind.size, -1, np.int64)
    up[spans] = slot[span_of]
    q, c = s.child(spans, "startLine")
    plain = np.isin(s.kind[c], (STR, SCALAR)) & ~s.is_null(c)
    for i, v in zip(up[q[plain]].tolist(), c[plain].tolist()):
        lines[i] = decimal_text(s.text(v))
    if "fact_name" in wanted:
        fact_name = field(facts, "kind")
    else:
        fact_name = [None] * facts.size
    put("fact", facts.size, root_no=root[of_file].tolist(), file_pos=fpos[of_file].tolist(), item_pos=item.tolist(),
        name=fact_name, value=lines)
    yield rows


def _run(wanted: frozenset):
    schema = pa.schema([(c, pa.int64() if c == "root_no" else pa.int32() if c.endswith("_pos") else pa.string()) for c in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.large_binary())
            roots, held, size = [], [], 0
            for no, x in zip(numbers, texts):
                x = x.as_py()
                if x is None:
                    continue
                roots.append(no), held.append(x)
                size += len(x)
                if size >= SLICE_BYTES:
                    for r in _shred(roots, held, wanted):
                        yield pa.RecordBatch.from_pydict(r, schema)
                    roots, held, size = [], [], 0
            if roots:
                for r in _shred(roots, held, wanted):
                    yield pa.RecordBatch.from_pydict(r, schema)

    return run


def latest_reports(reports: DataFrame) -> DataFrame:
    """(report_no, payload): of the rows of one report the last received; a null payload stays null."""
    last = F.max_by("payload", F.struct("received_at", F.xxhash64("payload")))  # payloads are not compared, only carried
    return reports.groupBy("report_no").agg(last.alias("payload"))


def shred_reports(reports: DataFrame, wanted: tuple[str, ...] = ("file", "capability", "fact_name")) -> DataFrame:
    """Rows of the child tables of every valid report; see OUT for the columns.

    record_kind `file`: one per entry of files[]; `capability`: one per named capability of a file, value its text or
    its object's status; `fact`: one per fact, name its kind, value the start line. Positions count from 0 and count
    null entries. `wanted` leaves out what a query does not read.

    Defined results. Null, empty, cut or otherwise invalid payloads give no rows, as does a payload that is no object
    or has no files array. Missing or null fields give nulls. Of a repeated key in an object the last one counts. Very
    long payloads are processed alone. Rows with a null report_no are one report.
    """
    return latest_reports(reports).mapInArrow(_run(frozenset(wanted)), OUT)


def subjects(envelopes: DataFrame) -> DataFrame:
    """(envelope_no, evidence_id, subject fields, commit): of the rows of one envelope with a commit the last received."""
    commit = F.col("subject.repository.commit")
    cells = F.struct(
        "received_at", "evidence_id", F.col("subject.authority").alias("authority"),
        F.col("subject.namespace").alias("namespace"), F.col("subject.value").alias("subject_value"),
        F.col("subject.repository.owner").alias("owner"), F.col("subject.repository.name").alias("name"),
        commit.alias("commit"),
    )
    last = envelopes.filter(commit.isNotNull()).groupBy("envelope_no").agg(F.max(cells).alias("s"))
    return last.select("envelope_no", "s.evidence_id", "s.authority", "s.namespace", "s.subject_value", "s.owner", "s.name", "s.commit")
