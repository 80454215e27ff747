"""Text and path expressions as Columns, so that the optimizer sees through them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: separators of query terms, the cap on shown text and what stands for the rest
TERM_SEPARATORS = r"[\s.,;:()\[\]{}<>\"'`|\\/!?@#$%^&*+=~-]+"
TEXT_CAP = 120
CONNECTORS = ("a", "to", "in", "the")


def tokenize(query: str) -> list[str]:
    """Terms of a query in order, repeats kept; an underscore does not separate."""
    return [t for t in re.split(TERM_SEPARATORS, query.strip().lower()) if t]


def tokens(c: Column) -> Column:
    """tokenize() for a column."""
    return F.filter(F.split(F.lower(F.trim(c)), TERM_SEPARATORS), lambda x: x != "")


def without_connectors(query: str) -> str:
    """A query of several words without its bare lower-case connectors; quoted phrases stay as they are."""
    parts = re.findall(r'"[^"]*"|\S+', query)
    if len(parts) < 2:
        return query
    return " ".join(p for p in parts if p not in CONNECTORS) or query


def term_kind(word: str) -> str:
    """What a query word looks like: route, path, command, artifact, symbol or plain word."""
    if re.fullmatch(r"/[\w\-:/{}\[\].*]*", word):
        return "route"
    if re.fullmatch(r"[\w.\-]+(?:/[\w.\-]+)+|[\w\-]+\.(?:tsx?|jsx?|py|kt|java|rs|json|md)", word):
        return "path"
    if re.fullmatch(r"--?[a-z][\w\-]*", word):
        return "command"
    if re.fullmatch(r"[\w\-]+\.(?:ya?ml|toml|xml|dot|svg|png)", word):
        return "artifact"
    if re.search(r"[a-z0-9][A-Z]|_|\w\.\w|\(\)$", word):
        return "symbol"
    return "word"


def shorten(c: Column) -> Column:
    """White space collapsed, at most TEXT_CAP characters."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > TEXT_CAP, F.concat(F.substring(flat, 1, TEXT_CAP - 3), F.lit("..."))).otherwise(flat)


def lines(c: Column) -> Column:
    """Lines of a text: split at \\n or \\r\\n, without the one empty line after a final line break."""
    parts = F.split(c, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def literal_pieces(c: Column, needle: str) -> Column:
    """A text cut at every non-overlapping occurrence of a literal, from the left."""
    return F.split(c, "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The path without its last part; '.' where there is one part."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(cut)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def normalize(path: Column) -> Column:
    """A posix path without `.` parts, doubled slashes and resolvable `..` parts."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(
        (x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)
    ).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def canonical_path(path: Column) -> Column:
    """True for a relative path with no backslash, drive, empty, `.` or `..` part."""
    parts = F.split(path, "/", -1)
    return (
        ~path.contains("\\") & ~path.startswith("/") & ~path.rlike("^[A-Za-z]:")
        & F.forall(parts, lambda x: (x != "") & (x != ".") & (x != ".."))
    )


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


# path predicates
def is_test_path(p: Column) -> Column:
    return p.rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(py|go|rs)$")


def is_fixture_path(p: Column) -> Column:
    return p.rlike(r"(?i)(^|/)(__)?fixtures?(__)?/")


def is_generated_path(p: Column) -> Column:
    return p.rlike(r"(?i)(^|/)generated/|\.(generated|gen)\.[jt]sx?$")


def is_docs_path(p: Column) -> Column:
    return p.rlike(r"(?i)(^|/)docs?/|\.mdx?$|(^|/)readme[^/]*$")


def term_kinds(word: Column) -> Column:
    """term_kind() for a column."""
    whole = lambda pattern: word.rlike(f"^(?:{pattern})$")
    return (
        F.when(whole(r"/[\w\-:/{}\[\].*]*"), "route").when(whole(r"[\w.\-]+(?:/[\w.\-]+)+|[\w\-]+\.(?:tsx?|jsx?|py|kt|java|rs|json|md)"), "path")
        .when(whole(r"--?[a-z][\w\-]*"), "command").when(whole(r"[\w\-]+\.(?:ya?ml|toml|xml|dot|svg|png)"), "artifact")
        .when(word.rlike(r"[a-z0-9][A-Z]|_|\w\.\w|\(\)$"), "symbol").otherwise("word")
    )


def without_connectors_column(query: Column) -> Column:
    """without_connectors() for a column."""
    parts = F.regexp_extract_all(query, F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    kept = F.array_join(F.filter(parts, lambda p: ~p.isin(*CONNECTORS)), " ")
    return F.when((F.size(parts) < 2) | (kept == ""), query).otherwise(kept)
