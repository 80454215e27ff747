"""The shape of a fact, common to all extractors."""

from __future__ import annotations

import hashlib

LITERAL_CAP = 256
FIELDS = ("record", "name", "kind", "line", "end_line", "exported", "owner", "detail")
OUT = "record string, name string, kind string, line int, end_line int, exported boolean, owner string, detail string"
Row = tuple


def row(record, name, kind="", line=0, end_line=None, exported=False, owner="", detail="") -> Row:
    return (record, name, kind, line, end_line, exported, owner, detail)


def literal(value: str, line: int, owner: str = "") -> Row:
    """A literal, capped; the hash is of the whole value."""
    return row("literal", value[:LITERAL_CAP], "string", line, owner=owner, detail=hashlib.sha256(value.encode("utf-8", "replace")).hexdigest())
