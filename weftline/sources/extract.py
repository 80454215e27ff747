"""Facts of source files: symbols, imports, calls, routes, requests, interface facts, models and literals.

An extractor is a plain function (path, text) -> rows; extractors are registered by extension and run in one pass over
the files. Python is read by its own parser, scripts by script_facts.py, Java, Kotlin and Rust by braces_facts.py, both
from tokens with brackets.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import extension
from weftline.sources.braces_facts import extract_java, extract_kotlin, extract_rust
from weftline.sources.rows import FIELDS, LITERAL_CAP, OUT, Row, literal, row
from weftline.sources.lineage_facts import extract_lineage
from weftline.sources.script_facts import extract_script

_registry: dict[str, Callable[[str, str], list[Row]]] = {}


def _script(path: str, text: str) -> list[Row]:
    return extract_script(path, text) + extract_lineage(path, text)


def register_extractor(ext: str, function: Callable[[str, str], list[Row]]) -> None:
    """Use `function` for files with this extension; the first registration of an extension wins."""
    _registry.setdefault(ext.lower(), function)


# Python
class _Python(ast.NodeVisitor):
    def __init__(self):
        self.rows: list[Row] = []
        self.owners: list[str] = []

    def owner(self) -> str:
        return ".".join(self.owners)

    def visit_def(self, node, kind: str) -> None:
        inside = bool(self.owners)
        name = node.name
        if kind == "function" and inside and self.kinds[-1] == "class":
            kind = "method"
        detail = ", ".join(a.arg for a in node.args.args) if hasattr(node, "args") else ", ".join(ast.unparse(b) for b in node.bases)
        self.rows.append(row("symbol", name, kind, node.lineno, node.end_lineno, not name.startswith("_"), self.owner(), detail))
        for d in node.decorator_list:
            self.route(d, name)
        if kind == "class" and any(re.search(r"(^|\.)(Model|Base|DeclarativeBase)$", ast.unparse(b)) for b in node.bases):
            self.model(node)
        self.owners.append(name)
        self.kinds.append(kind)
        self.generic_visit(node)
        self.owners.pop()
        self.kinds.pop()

    kinds: list[str]

    def visit_FunctionDef(self, node):
        self.visit_def(node, "function")

    def visit_AsyncFunctionDef(self, node):
        self.visit_def(node, "function")

    def visit_ClassDef(self, node):
        self.visit_def(node, "class")

    def visit_Import(self, node):
        for a in node.names:
            self.rows.append(row("import", a.name, "module", node.lineno, detail=a.asname or a.name))

    def visit_ImportFrom(self, node):
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.rows.append(row("import", base, "wildcard" if a.name == "*" else "named", node.lineno, owner=a.name, detail=a.asname or a.name))

    def visit_Call(self, node):
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.rows.append(row("call", ast.unparse(node.func), "call", node.lineno, owner=self.owner()))
        self.generic_visit(node)

    def visit_Constant(self, node):
        if isinstance(node.value, str):
            self.rows.append(literal(node.value, node.lineno, self.owner()))

    def route(self, d, handler: str) -> None:
        """@app.get("/x"), @router.route("/x", methods=[...])"""
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
            verb = d.func.attr
            if verb in ("get", "post", "put", "patch", "delete", "head", "options"):
                self.rows.append(row("route", d.args[0].value, verb.upper(), d.lineno, owner=handler, detail="python"))
            elif verb == "route":
                verbs = [e.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple)) for e in k.value.elts if isinstance(e, ast.Constant)]
                for v in verbs or ["GET"]:
                    self.rows.append(row("route", d.args[0].value, str(v).upper(), d.lineno, owner=handler, detail="python"))

    def model(self, node) -> None:
        self.rows.append(row("model", node.name, "orm", node.lineno, node.end_lineno))
        for s in node.body:
            target = s.targets[0] if isinstance(s, ast.Assign) else s.target if isinstance(s, ast.AnnAssign) else None
            if isinstance(target, ast.Name):
                value = ast.unparse(s.value)[:LITERAL_CAP] if s.value is not None else ast.unparse(s.annotation)[:LITERAL_CAP]
                self.rows.append(row("model_field", target.id, "orm", s.lineno, owner=node.name, detail=value))


def extract_python(path: str, text: str) -> list[Row]:
    del path
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [row("warning", "not parsed", "syntax", getattr(e, "lineno", 0) or 0)]
    v = _Python()
    v.kinds = []
    try:
        v.visit(tree)
    except RecursionError:
        v.rows.append(row("warning", "nested too deep", "syntax"))
    return v.rows


# project files
def extract_xml(path: str, text: str) -> list[Row]:
    """Android manifests, resources and navigation graphs: elements with a name or id."""
    import xml.etree.ElementTree as ET

    try:
        tree = ET.fromstring(text.encode())
    except ET.ParseError as e:
        return [row("warning", "not parsed", "xml", e.position[0])]
    rows = []

    def walk(e, owner: str) -> None:
        attrs = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
        name = attrs.get("name") or attrs.get("id") or ""
        if name:
            rows.append(row("element", name, e.tag.rsplit("}", 1)[-1], owner=owner, detail=(e.text or "").strip()[:LITERAL_CAP] or attrs.get("destination", "")))
        for c in e:
            walk(c, name or owner)

    walk(tree, "")
    return rows


def extract_toml(path: str, text: str) -> list[Row]:
    """Cargo manifests and version catalogs: leaf settings with dotted names."""
    import tomllib

    del path
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return [row("warning", "not parsed", "toml")]
    rows = []

    def walk(v, name: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{name}.{k}" if name else k)
        else:
            rows.append(row("setting", name, type(v).__name__, detail=str(v)[:LITERAL_CAP]))

    walk(doc, "")
    return rows


_GRADLE_CALL = re.compile(r"""\b(?P<kind>implementation|api|compileOnly|runtimeOnly|testImplementation|androidTestImplementation|debugImplementation|kapt|ksp|id|include)\b\s*\(?\s*(?=["']|project|platform)""")
_GRADLE_PROJECT = re.compile(r"""project\s*\(\s*(?:path\s*[:=]\s*)?["'](?P<name>[^"']+)["']""")
_GRADLE_TEXT = re.compile(r"""["'](?P<name>[^"']+)["']""")


def extract_gradle(path: str, text: str) -> list[Row]:
    """Plugins, included modules and dependencies of Gradle files, several to a line or over lines; comments are blank.

    A dependency on a module of the project has the kind `project`, its configuration as detail.
    """
    del path
    code = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text) if "//" in text or "/*" in text else text
    rows = []
    for m in _GRADLE_CALL.finditer(code):
        kind, line = m["kind"], code.count("\n", 0, m.start()) + 1
        project = _GRADLE_PROJECT.match(code, m.end())
        if project:
            rows.append(row("dependency", project["name"], "project", line, detail=kind))
            continue
        inner = re.compile(r"platform\s*\(\s*").match(code, m.end())
        at = inner.end() if inner else m.end()
        while found := _GRADLE_TEXT.match(code, at):
            rows.append(row("dependency", found["name"], kind, line))
            more = re.compile(r"\s*,\s*").match(code, found.end()) if kind == "include" else None
            if not more:
                break
            at = more.end()
    return rows


for _ext, _fn in (
    (".py", extract_python), (".ts", _script), (".tsx", _script), (".js", _script), (".jsx", _script),
    (".mjs", _script), (".cjs", _script), (".mts", _script), (".kt", extract_kotlin), (".java", extract_java),
    (".rs", extract_rust), (".xml", extract_xml), (".toml", extract_toml), (".gradle", extract_gradle), (".kts", extract_gradle),
):
    register_extractor(_ext, _fn)


def extract_files(files: DataFrame, keys: list[str], path: str = "path", content: str = "content", records: tuple[str, ...] = (), number: str = "") -> DataFrame:
    """One row for each fact: the key columns, the path and the fields of OUT; only the named records, if any are named.

    `number` names one more column, the place of a fact among those of its file: equal files give equal rows.

    One pass without a shuffle. Null contents and files of other extensions give no rows; a file that an extractor
    cannot read gives a `warning`.
    """
    registry = dict(_registry)
    if records and "lineage" not in records:
        registry = {e: extract_script if f is _script else f for e, f in registry.items()}
    elif set(records) == {"lineage"}:
        registry = {e: extract_lineage for e, f in registry.items() if f is _script}
    known = F.array(*[F.lit(x) for x in registry])
    picked = files.filter(F.col(content).isNotNull() & F.array_contains(known, extension(F.col(path)))).select(*keys, F.col(path).alias("path"), F.col(content).alias("content"))
    shape = picked.drop("content").schema
    wanted = frozenset(records)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", " + OUT + (f", `{number}` int" if number else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"line": pa.int32(), "end_line": pa.int32(), "exported": pa.bool_()}
        for b in batches:
            take: list[int] = []
            place: list[int] = []
            cells: list[list] = [[] for _ in FIELDS]
            for i, (p, text) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                ext = re.search(r"(\.[^./]+)$", p)
                for n, r in enumerate(registry[ext.group(1).lower()](p, text)):
                    if wanted and r[0] not in wanted:
                        continue
                    take.append(i)
                    place.append(n)
                    for c, v in zip(cells, r):
                        c.append(v)
            picked_rows = [c.take(pa.array(take, pa.int64())) for c in b.columns[:-1]]
            facts = [pa.array(c, types.get(f, pa.string())) for f, c in zip(FIELDS, cells)]
            if number:
                facts.append(pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([*picked_rows, *facts], names=[*b.schema.names[:-1], *FIELDS, *([number] if number else [])])

    return picked.mapInArrow(run, schema)
