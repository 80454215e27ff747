"""Facts of TypeScript and JavaScript files, from tokens with brackets and scopes.

Declarations are found where the grammar puts them (statements, class bodies), not by what a line looks like. Import and
export bindings are kept by name, so calls can be joined to what other files export; a call whose name is declared or
written in an enclosing function is marked as shadowed, one whose name the file itself declares or writes as local.
"""

from __future__ import annotations

import re

from weftline.sources import tokens
from weftline.sources.rows import Row, literal, row

VERBS = frozenset("get post put patch delete head options all use".split())
NEST = frozenset("Get Post Put Patch Delete Head Options All Controller".split())
CLIENTS = frozenset("axios http https client request".split())
NOT_CALLED = frozenset("if for while switch catch return function typeof await yield super import constructor with do else in of void delete new throw case".split())
MODIFIERS = frozenset("public private protected static async readonly override abstract declare get set accessor".split())
TESTS, LOCATORS = frozenset(("describe", "it", "test")), re.compile(r"getBy(?:Role|Text|TestId|Label|LabelText|Placeholder)|locator")
STORES, STORE_VERBS = frozenset(("localStorage", "sessionStorage")), frozenset(("getItem", "setItem", "removeItem"))
STATEMENT_END = frozenset(("", ";", "}", "{", ")", "export", "default", "async", "declare", "abstract"))


class _Scope:
    """A function, class, namespace or the file: its last token, its name, and the names that hide imported ones in it."""

    __slots__ = ("end", "open", "kind", "name", "line", "hidden", "params")

    def __init__(self, end: int, open_: int, kind: str, name: str = "", line: int = 0, params: tuple = ()):
        self.end, self.open, self.kind, self.name, self.line = end, open_, kind, name, line
        self.hidden: set[str] = set(params)
        self.params = params


class Script:
    def __init__(self, path: str, text: str):
        self.typed = bool(re.search(r"\.[cm]?tsx?$", path))
        self.t = tokens.script(text, not re.search(r"\.[cm]?ts$", path))
        self.rows: list[Row] = []
        self.calls: list[tuple] = []
        self.wrappers: dict[str, str] = {}
        self.uses: list[tuple[str, str, int, str]] = []
        self.names_at: dict[int, tuple[str, int]] = {}  # where a value begins -> the variable it is given to
        self.skip: set[int] = set()
        self.scopes = [_Scope(len(self.t.k), -1, "file")]
        self.parents = [-1]

    # reading
    def word(self, i: int) -> str:
        return self.t.at(i) if self.t.kind(i) == "id" else ""

    def angle(self, i: int) -> int:
        """After type arguments that begin at i, or i."""
        t = self.t
        if t.kind(i) != "<":
            return i
        depth, j = 0, i
        while j < len(t.k):
            k = t.k[j]
            if k == "<":
                depth += 1
            elif k == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif k in tokens.OPENERS:
                j = t.end(j)
            elif k in (";", ")", "]", "}"):
                return i
            j += 1
        return i

    def bound(self, i: int) -> tuple[list[str], int]:
        """The names that a pattern at i binds, and what follows it."""
        t = self.t
        if t.kind(i) == "id":
            return [t.at(i)], i + 1
        if t.kind(i) not in ("{", "["):
            return [], i + 1
        names, j, end, is_object = [], i + 1, t.end(i), t.kind(i) == "{"
        while j < end:
            if t.kind(j) == "...":
                j += 1
            if is_object and t.kind(j + 1) == ":":
                j += 2
            elif is_object and t.kind(j) == "[":
                j = t.end(j) + 2
            got, j = self.bound(j)
            names += got
            while j < end and t.kind(j) != ",":
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
            j += 1
        return names, end + 1

    def parameters(self, i: int) -> tuple:
        """The names that the parameters in the bracket at i bind."""
        t, names, j, end = self.t, [], i + 1, self.t.end(i)
        while j < end:
            while t.kind(j) == "@":
                j = t.end(j + 2) + 1 if t.kind(j + 2) == "(" else j + 2
            while self.word(j) in MODIFIERS and t.kind(j + 1) in ("id", "{", "["):
                j += 1
            j += t.kind(j) == "..."
            got, j = self.bound(j)
            names += got
            while j < end and t.kind(j) != ",":
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
            j += 1
        return tuple(names)

    def body(self, i: int, arrow: bool) -> int:
        """After the parameters: the token that opens the body, past a return type; -1 without one."""
        t = self.t
        if t.kind(i) == ":":
            i += 1
            type_next = True
            while i < len(t.k):
                k = t.kind(i)
                if k == "=>" and arrow and t.kind(i - 1) != ")":
                    break
                if k == "=>" and arrow and not type_next:
                    break
                if k == "{" and not type_next:
                    break
                if k in (";", ",", ")", "]", "}", "") or (k == "=" and not type_next):
                    return -1
                type_next = k in (":", "|", "&", "=>", "<", ",", "is", "extends") or t.at(i) in ("is", "keyof", "readonly", "typeof", "asserts")
                i = t.end(i) + 1 if k in tokens.OPENERS else i + 1
        if arrow:
            return i + 1 if t.kind(i) == "=>" else -1
        return i if t.kind(i) == "{" else -1

    def value_end(self, i: int) -> int:
        """The last token of the expression that begins at i."""
        t = self.t
        while i < len(t.k):
            k = t.kind(i)
            if k in (",", ";", ")", "]", "}"):
                return i - 1
            i = t.end(i) + 1 if k in tokens.OPENERS else i + 1
        return len(t.k) - 1

    # writing
    def add(self, *cells, **more) -> None:
        self.rows.append(row(*cells, **more))

    def function(self) -> _Scope:
        return next(s for s in reversed(self.scopes) if s.kind in ("function", "file"))

    def caller(self) -> tuple[str, int]:
        for s in reversed(self.scopes):
            if s.kind == "function" and s.name:
                return s.name, s.line
        return "", 0

    def owner_path(self) -> str:
        return ".".join(s.name for s in self.scopes if s.name)

    def symbol(self, i: int, name: str, kind: str, end: int, exported: bool, detail: str = "") -> None:
        self.add("symbol", name, kind, self.t.line(i), self.t.end_line(min(end, len(self.t.k) - 1)), exported, self.owner_path(), detail)

    def run(self) -> list[Row]:
        t = self.t
        i, n = 0, len(t.k)
        while i < n:
            while len(self.scopes) > 1 and self.scopes[-1].end < i:
                self.scopes.pop()
            k = t.k[i]
            top = self.scopes[-1]
            if top.kind == "class" and self.parents[-1] == top.open and k not in ("}", ";", ","):
                i = self.member(i)
                continue
            if k in tokens.OPENERS:
                if k == "(" and i not in self.skip:
                    self.arrow(i)
                self.parents.append(i)
            elif k in (")", "]", "}"):
                while len(self.parents) > 1 and self.parents[-1] > t.m[i] >= 0:
                    self.parents.pop()
                if len(self.parents) > 1 and self.parents[-1] == t.m[i]:
                    self.parents.pop()
            elif k == "id":
                i = self.name(i)
                continue
            elif k in tokens.ASSIGNMENTS and i not in self.skip:
                self.write(i - 1)
                if k == "=" and t.kind(i + 1) == "id" and t.kind(i + 2) not in (".", "(", "[", "?.", "=>", "<"):
                    self.function().hidden.add(t.at(i + 1))
            elif k in ("++", "--"):
                self.write(i - 1 if t.kind(i - 1) in ("id", "]", ")") else i + 1)
            elif k == "str":
                self.rows.append(literal(t.x[i], t.line(i), self.caller()[0]))
            elif k == "jsxname" and t.x[i][:1].isupper():
                self.add("component", t.x[i], "use", t.line(i), owner=self.caller()[0])
            elif k == "jsxattr" and re.match(r"on[A-Z]", t.x[i]) and t.kind(i + 1) == "{":
                self.add("handler", t.x[i], "", t.line(i), owner=self.caller()[0], detail=t.text[t.e[i + 1] : t.s[t.end(i + 1)]].strip())
            elif k == "jsxtext" and re.search(r"[A-Za-z]", t.x[i]):
                self.add("ui_string", t.x[i], "jsx", t.line(i), owner=self.caller()[0])
            elif k == "@" and t.kind(i + 1) == "id":
                self.decorator(i)
            i += 1
        self.finish()
        return self.rows

    def write(self, j: int) -> None:
        """The root of a written place is hidden in its function."""
        t = self.t
        while j > 0:
            if t.kind(j) in ("]", ")"):
                j = t.m[j] - 1 if t.m[j] > 0 else -1
            elif t.kind(j - 1) in (".", "?."):
                j -= 2
            else:
                break
        if t.kind(j) == "id":
            self.function().hidden.add(t.at(j))

    def enter(self, begin: int, end: int, kind: str, name: str = "", at: int = 0, params: tuple = ()) -> None:
        self.scopes.append(_Scope(end, begin, kind, name, self.t.line(at), params))

    def arrow(self, i: int) -> None:
        """An arrow function with its parameters in the bracket at i."""
        t = self.t
        q = t.end(i)
        if t.kind(q + 1) != "=>" and not (self.typed and t.kind(q + 1) == ":"):
            return
        b = self.body(q + 1, True)
        if b < 0:
            return
        begin = i - 1 if t.at(i - 1) == "async" else i
        name, at = self.names_at.get(begin, self.names_at.get(i, ("", 0)))
        end = t.end(b) if t.kind(b) == "{" else self.value_end(b)
        self.enter(b, end, "function", name, at or i, self.parameters(i))

    # names
    def name(self, i: int) -> int:
        """A name outside class bodies; gives where to go on."""
        t = self.t
        w, before, after = t.at(i), t.kind(i - 1) if t.kind(i - 1) != "id" else t.at(i - 1), t.kind(i + 1)
        member = before in (".", "?.")
        if not member and after != ":" and not (after == "(" and w in ("get", "set", "type", "namespace", "module")):
            rule = getattr(self, f"at_{w}", None) if w in _STATEMENTS else None
            if rule:
                to = rule(i, before)
                if to > i:
                    return to
        if after == "=>" and not member and i not in self.skip:
            b = i + 2
            name, at = self.names_at.get(i - 1 if before == "async" else i, ("", 0))
            self.enter(b, t.end(b) if t.kind(b) == "{" else self.value_end(b), "function", name, at or i, (w,))
            return i + 2
        p = self.angle(i + 1)
        if t.kind(p) == "?." and t.kind(p + 1) == "(":
            p += 1
        if t.kind(p) == "(" and (w not in NOT_CALLED or member):
            # a method of an object has its body after its parameters
            if not member and before in ("{", ",", "async", "get", "set", "*") and self.parents[-1] >= 0 and t.kind(self.parents[-1]) == "{":
                b = self.body(t.end(p) + 1, False)
                if b >= 0 and (before != "{" or t.kind(self.parents[-1] - 1) in ("=", "(", ",", ":", "return", "[", "?", "=>")):
                    self.skip.add(p)
                    self.enter(b, t.end(b), "function", w, i, self.parameters(p))
                    return p
            self.call(i, p)
        return i + 1

    def at_delete(self, i: int, before: str) -> int:
        self.write(self.chain_end(i + 1))
        return i

    def chain_end(self, i: int) -> int:
        t = self.t
        while t.kind(i + 1) in (".", "?.") or t.kind(i + 1) == "[":
            i = t.end(i + 1) if t.kind(i + 1) == "[" else i + 2
        return i

    def at_import(self, i: int, before: str) -> int:
        t, line = self.t, self.t.line(i)
        if t.kind(i + 1) == "(":
            if t.kind(i + 2) == "str":
                self.add("import", t.at(i + 2), "dynamic", line)
            return i
        if t.kind(i + 1) == "str":
            self.add("import", t.at(i + 1), "import", line)
            self.rows.append(literal(t.at(i + 1), line))
            return i + 2
        j = i + 1
        only_types = self.word(j) == "type" and t.kind(j + 1) in ("id", "{", "*") and t.at(j + 1) != "from"
        j += only_types
        bindings: list[tuple[str, str, bool]] = []
        while j < len(t.k):
            if t.kind(j) == "id" and t.at(j) != "from":
                if t.kind(j + 1) == "=":  # import x = require("y")
                    if t.at(j + 2) == "require" and t.kind(j + 4) == "str":
                        self.add("import", t.at(j + 4), "require", line, detail=t.at(j))
                        self.add("binding", t.at(j), "require", line, owner="*", detail=t.at(j + 4))
                        return t.end(j + 3) + 1
                    return j + 1
                bindings.append((t.at(j), "default", only_types))
                j += 1
            elif t.kind(j) == "*":
                bindings.append((t.at(j + 2), "*", only_types))
                j += 3
            elif t.kind(j) == "{":
                end = t.end(j)
                j += 1
                while j < end:
                    typed = self.word(j) == "type" and t.kind(j + 1) in ("id", "str") and t.at(j + 1) != "as"
                    j += typed
                    local = t.at(j + 2) if t.at(j + 1) == "as" else t.at(j)
                    bindings.append((local, t.at(j), only_types or typed))
                    j += 4 if t.at(j + 1) == "as" else 2
                j = end + 1
            elif t.kind(j) == ",":
                j += 1
            else:
                break
        if t.at(j) != "from" or t.kind(j + 1) != "str":
            return i
        source = t.at(j + 1)
        self.add("import", source, "import", line, detail=" ".join(t.text[t.e[i] : t.s[j]].split()))
        self.rows.append(literal(source, t.line(j + 1)))
        for local, imported, typed in bindings:
            self.add("binding", local, "type" if typed else "import", line, owner=imported, detail=source)
            if typed:
                self.scopes[0].hidden.add(local)
        return j + 2

    def at_export(self, i: int, before: str) -> int:
        t, line, j = self.t, self.t.line(i), i + 1
        if t.at(j) == "type" and t.kind(j + 1) in ("{", "*"):
            j += 1
        if t.kind(j) == "*":
            as_ = t.at(j + 2) if t.at(j + 1) == "as" else ""
            j += 3 if as_ else 1
            if t.at(j) == "from":
                self.add("import", t.at(j + 1), "export-all", line, detail=f"* as {as_}" if as_ else "*")
                self.add("export", as_ or "*", "re-export", line, owner="*", detail=t.at(j + 1))
                return j + 2
        elif t.kind(j) == "{":
            end = t.end(j)
            source = t.at(end + 2) if t.at(end + 1) == "from" else ""
            if source:
                self.add("import", source, "re-export", line, detail=t.text[t.s[j] : t.e[end]])
            while (j := j + 1) < end:
                if t.kind(j) != "id" or (t.at(j) == "type" and t.kind(j + 1) == "id" and t.at(j + 1) != "as"):
                    continue
                out = t.at(j + 2) if t.at(j + 1) == "as" else t.at(j)
                self.add("export", out, "re-export" if source else "alias", line, owner=t.at(j), detail=source)
                j += 2 if t.at(j + 1) == "as" else 0
            return end + (3 if source else 1)
        elif t.at(j) == "default" and t.kind(j + 1) == "id" and t.at(j + 1) not in ("function", "class", "async", "abstract", "new", "await"):
            if t.kind(j + 2) in (";", "") or t.line(j + 2) > t.line(j + 1):
                self.add("export", "default", "default", line, owner=t.at(j + 1))
        elif t.kind(j) == "=" and t.kind(j + 1) == "id":
            self.add("export", "=", "default", line, owner=t.at(j + 1))
        return i + 1

    def begins(self, i: int, before: str) -> bool:
        """A statement may begin at i."""
        return before in STATEMENT_END or self.t.line(i) > self.t.line(i - 1)

    def exported(self, i: int) -> str:
        """How the declaration whose keyword stands at i is exported: '', direct or default."""
        j = i - 1
        while self.word(j) in ("async", "declare", "abstract", "const"):
            j -= 1
        if self.word(j) == "export":
            return "direct"
        return "default" if self.word(j) == "default" and self.word(j - 1) == "export" else ""

    def note_export(self, how: str, name: str, at: int) -> None:
        if how:
            self.add("export", "default" if how == "default" else name, how, self.t.line(at), owner=name)

    def at_function(self, i: int, before: str) -> int:
        t, j = self.t, i + 1
        j += t.kind(j) == "*"
        name = t.at(j) if t.kind(j) == "id" else ""
        p = self.angle(j + bool(name))
        if t.kind(p) != "(":
            return i
        b = self.body(t.end(p) + 1, False)
        end = t.end(b) if b >= 0 else t.end(p)
        statement = self.begins(i, before)
        how = self.exported(i)
        if name:
            self.function().hidden.add(name)
        if (name or how) and statement:
            at = i - 1 if before == "async" else i
            self.symbol(at, name or "default", "function", end, bool(how), ", ".join(self.parameters(p)))
            self.note_export(how, name or "default", at)
        self.skip.add(p)
        if b >= 0:
            given = self.names_at.get(i, ("", 0))[0]
            self.enter(b, end, "function", name or given or ("default" if how else ""), i, self.parameters(p))
        return p

    def at_class(self, i: int, before: str) -> int:
        t = self.t
        name = t.at(i + 1) if t.kind(i + 1) == "id" and t.at(i + 1) not in ("extends", "implements") else ""
        j = i + 1
        while j < len(t.k) and t.kind(j) != "{" and t.kind(j) != ";":
            j = t.end(j) + 1 if t.kind(j) in ("(", "[") else self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
        if t.kind(j) != "{":
            return i
        head = t.text[t.s[i] : t.s[j]].split()
        how = self.exported(i)
        if name or how:
            self.symbol(i, name or "default", "class", t.end(j), bool(how), " ".join(head))
            self.note_export(how, name or "default", i)
            self.function().hidden.add(name)
        self.enter(j, t.end(j), "class", name or "default", i)
        self.parents.append(j)
        return j + 1

    def at_interface(self, i: int, before: str) -> int:
        t = self.t
        if t.kind(i + 1) != "id" or not self.begins(i, before):
            return i
        j = i + 2
        while j < len(t.k) and t.kind(j) not in ("{", ";"):
            j = self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
        if t.kind(j) != "{":
            return i
        name = t.at(i + 1)
        self.symbol(i, name, "interface", t.end(j), bool(self.exported(i)))
        self.model(name, "interface", i, j)
        return t.end(j) + 1

    def at_type(self, i: int, before: str) -> int:
        t = self.t
        if t.kind(i + 1) != "id" or not self.begins(i, before):
            return i
        eq = self.angle(i + 2)
        if t.kind(eq) != "=":
            return i
        name, j = t.at(i + 1), eq + 1
        while j < len(t.k) and t.kind(j) not in (";", "}", ")"):
            if j > eq + 1 and t.line(j) > t.line(j - 1) and t.kind(j) not in ("|", "&", "?", ":", "=>", ".") and t.kind(j - 1) not in ("|", "&", "?", ":", "=>", "=", ".", "extends"):
                if t.at(j) != "extends" and t.at(j - 1) not in ("extends", "keyof", "typeof"):
                    break
            j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
        self.symbol(i, name, "type", j - 1, bool(self.exported(i)))
        if t.kind(eq + 1) == "{" and t.end(eq + 1) == j - 1:
            first = eq + 2
            mapped = t.kind(first) == "[" and any(t.at(x) == "in" for x in range(first, t.end(first))) or t.at(first) in ("readonly", "-", "+") and t.kind(first + 1) == "["
            if mapped:
                self.add("model_unsupported", name, "mapped", t.line(i))
            else:
                self.model(name, "type", i, eq + 1)
        else:
            parts = [t.kind(x) if t.kind(x) != "id" else t.at(x) for x in range(eq + 1, j)]
            kind = "conditional" if "extends" in parts and "?" in parts else "function" if "=>" in parts else "intersection" if "&" in parts else "union" if "|" in parts else "alias"
            self.add("model_unsupported", name, kind, t.line(i), detail=" ".join(t.text[t.s[eq + 1] : t.e[j - 1]].split()) if j > eq + 1 else "")
        return j

    def at_enum(self, i: int, before: str) -> int:
        t = self.t
        if t.kind(i + 1) != "id" or t.kind(i + 2) != "{":
            return i
        how = self.exported(i)
        self.symbol(i, t.at(i + 1), "enum", t.end(i + 2), bool(how))
        self.note_export(how, t.at(i + 1), i)
        return t.end(i + 2) + 1

    def at_namespace(self, i: int, before: str) -> int:
        t, j = self.t, i + 1
        if t.kind(j) not in ("id", "str") or not self.begins(i, before):
            return i
        while t.kind(j + 1) == ".":
            j += 2
        if t.kind(j + 1) != "{":
            return i
        name = t.at(j) if j == i + 1 else t.text[t.s[i + 1] : t.e[j]]
        self.symbol(i, name, "namespace", t.end(j + 1), bool(self.exported(i)))
        self.enter(j + 1, t.end(j + 1), "namespace", name, i)
        return j + 1

    at_module = at_namespace

    def at_const(self, i: int, before: str) -> int:
        t, j = self.t, i + 1
        if t.at(j) == "enum":
            return self.at_enum(j, before)
        how = self.exported(i)
        scope = self.function()
        top = self.parents[-1] == -1 or (self.scopes[-1].kind == "namespace" and self.parents[-1] == self.scopes[-1].open)
        first = True
        while t.kind(j) in ("id", "{", "["):
            at = j
            names, j = self.bound(j)
            if t.kind(j) == "!":
                j += 1
            if t.kind(j) == ":":
                j += 1
                while j < len(t.k) and t.kind(j) not in ("=", ",", ";", ")", "}", "]") and t.at(j) not in ("of", "in"):
                    if t.line(j) > t.line(j - 1) and t.kind(j) in ("id", "}") and t.kind(j - 1) not in ("|", "&", ":", "=>"):
                        break
                    j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
            value = j + 1 if t.kind(j) == "=" else -1
            source = self.required(value) if value >= 0 else ""
            if source and scope.kind == "file":
                self.bind_required(at, source)
            else:
                scope.hidden.update(names)
            if value >= 0:
                self.skip.add(j)
                if t.kind(at) == "id":
                    self.names_at[value] = (t.at(at), value)
                if t.kind(value) == "id" and t.kind(value + 1) in (";", ",", "") or t.kind(value) == "id" and t.line(value + 1) > t.line(value) and t.kind(value + 1) not in (".", "(", "?."):
                    scope.hidden.add(t.at(value))
            if top and t.kind(at) == "id":
                end = self.value_end(value) if value >= 0 else j - 1
                if value >= 0 and t.kind(end) != "}" and end > value:
                    end = next((x - 1 for x in range(value + 1, end + 1) if t.line(x) > t.line(x - 1) and t.kind(x) == "id" and self.parents_same(value, x) and t.kind(x - 1) in tokens._AFTER_VALUE), end)
                self.symbol(i if first else at, t.at(at), "const", end, bool(how), "function" if value >= 0 and self.is_function(value) else "")
                self.note_export(how, t.at(at), i)
            first = False
            if value >= 0:
                return value  # the value is read next; a second declarator is met after its comma
            if t.kind(j) != ",":
                break
            j += 1
        return max(j, i + 1)

    at_let = at_var = at_const

    def parents_same(self, a: int, b: int) -> bool:
        """No bracket is open between a and b."""
        t, j = self.t, a
        while j < b:
            j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
        return j == b

    def is_function(self, i: int) -> bool:
        t = self.t
        j = i + 1 if t.at(i) == "async" else i
        if t.at(j) == "function" or t.kind(j + 1) == "=>":
            return True
        j = self.angle(j)
        return t.kind(j) == "(" and self.body(t.end(j) + 1, True) >= 0

    def required(self, i: int) -> str:
        t = self.t
        return t.at(i + 2) if t.at(i) == "require" and t.kind(i + 1) == "(" and t.kind(i + 2) == "str" and t.end(i + 1) == i + 3 else ""

    def bind_required(self, i: int, source: str) -> None:
        t = self.t
        if t.kind(i) == "id":
            self.add("binding", t.at(i), "require", t.line(i), owner="*", detail=source)
        elif t.kind(i) == "{":
            j, end = i + 1, t.end(i)
            while j < end:
                local = t.at(j + 2) if t.kind(j + 1) == ":" else t.at(j)
                if t.kind(j) == "id":
                    self.add("binding", local, "require", t.line(j), owner=t.at(j), detail=source)
                while j < end and t.kind(j) != ",":
                    j += 1
                j += 1

    def at_catch(self, i: int, before: str) -> int:
        if self.t.kind(i + 1) == "(":
            self.function().hidden.update(self.bound(i + 2)[0])
            self.skip.add(i + 1)
        return i

    # classes
    def member(self, i: int) -> int:
        """A member of a class body at i; gives where to go on."""
        t, scope = self.t, self.scopes[-1]
        j = i
        while t.kind(j) == "@":
            self.decorator(j)
            j += 2
            while t.kind(j) == ".":
                j += 2
            j = t.end(j) + 1 if t.kind(j) == "(" else j
        at, private = j, False
        while self.word(j) in MODIFIERS and t.kind(j + 1) in ("id", "str", "num", "[", "{", "*", "#"):
            if t.at(j) == "static" and t.kind(j + 1) == "{":
                self.enter(j + 1, t.end(j + 1), "function", "", j)
                return j + 1
            private |= t.at(j) == "private"
            j += 1
        j += t.kind(j) == "*"
        name = t.at(j)
        if t.kind(j) == "[":
            name, j = t.text[t.s[j] : t.e[t.end(j)]], t.end(j)
        elif t.kind(j) not in ("id", "str", "num"):
            return max(i + 1, j + 1)
        j += 1
        optional = t.kind(j) == "?"
        j += t.kind(j) in ("?", "!")
        p = self.angle(j)
        if t.kind(p) == "(":
            b = self.body(t.end(p) + 1, False)
            end = t.end(b) if b >= 0 else t.end(p)
            names = self.parameters(p)
            self.symbol(at, name, "method", end, False, ", ".join(names))
            if name == "constructor":
                self.injected(p, scope.name)
            if b >= 0:
                self.skip.add(p)
                self.enter(b, end, "function", name, at, names)
                return p
            return end + 1
        kind = ""
        if t.kind(j) == ":":
            e = j + 1
            while e < len(t.k) and t.kind(e) not in ("=", ";", "}") and not (e > j + 1 and t.line(e) > t.line(e - 1) and t.kind(e) not in ("|", "&")):
                e = t.end(e) + 1 if t.kind(e) in tokens.OPENERS else self.angle(e) if t.kind(e) == "<" and self.angle(e) > e else e + 1
            kind = " ".join(t.text[t.s[j + 1] : t.e[e - 1]].split()) if e > j + 1 else ""
            j = e
        if t.kind(j) == "(":
            return j + 1
        self.add("model_field", name, "optional" if optional else "required", t.line(at), owner=scope.name, detail=kind)
        if t.kind(j) == "=":
            self.skip.add(j)
            self.names_at[j + 1] = (name, at)
            # the value is read as a scope of its own, so that members begin after it
            end = j + 1
            while end < scope.end and t.kind(end) not in (";", "}") and not (end > j + 1 and t.line(end) > t.line(end - 1) and t.kind(end - 1) in tokens._AFTER_VALUE and t.kind(end) in ("id", "@", "#", "[", "*", "str")):
                end = t.end(end) + 1 if t.kind(end) in tokens.OPENERS else end + 1
            self.enter(j, max(j, end - 1), "value")
            return j + 1
        return max(i + 1, j)

    def injected(self, p: int, owner: str) -> None:
        """Fields that a constructor declares by modifiers of its parameters."""
        t = self.t
        for j in range(p + 1, t.end(p)):
            if self.word(j) in ("public", "private", "protected", "readonly") and t.kind(j + 1) == "id" and t.kind(j + 2) in (":", "?"):
                self.add("model_field", t.at(j + 1), "required" if t.kind(j + 2) == ":" else "optional", t.line(j), owner=owner, detail=t.at(j + 3) if t.kind(j + 2) == ":" else t.at(j + 4))

    def model(self, name: str, kind: str, at: int, open_: int) -> None:
        """Fields of an object type; methods and signatures are no fields."""
        t, j, end = self.t, open_ + 1, self.t.end(open_)
        self.add("model", name, kind, t.line(at), t.end_line(end), bool(self.exported(at)))
        while j < end:
            j += self.word(j) == "readonly" and t.kind(j + 1) in ("id", "str")
            start, label = j, t.at(j)
            if t.kind(j) == "[":
                label, j = "", t.end(j)
            j += 1
            optional = t.kind(j) == "?"
            j += optional
            colon = j if t.kind(j) == ":" else -1
            while j < end and t.kind(j) not in (";", ",") and not (j > start + 1 and t.line(j) > t.line(j - 1) and t.kind(j) not in ("|", "&", "=>", "?", ":") and t.kind(j - 1) not in ("|", "&", "=>", ":", "?")):
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
            if colon >= 0 and label:
                self.add("model_field", label, "optional" if optional else "required", t.line(start), owner=name, detail=" ".join(t.text[t.s[colon + 1] : t.e[j - 1]].split()) if j > colon + 1 else "")
            j += t.kind(j) in (";", ",")
            j = max(j, start + 1)

    def decorator(self, i: int) -> None:
        t = self.t
        if t.at(i + 1) in NEST and t.kind(i + 2) == "(":
            path = t.at(i + 3) if t.kind(i + 3) in ("str", "tmpl") else ""
            self.add("route", path, t.at(i + 1).upper(), t.line(i), detail="nest")

    # calls
    def call(self, i: int, p: int) -> None:
        """A call of the name at i with its arguments in the bracket at p, and what it means."""
        t, j = self.t, i
        while t.kind(j - 1) in (".", "?.") and t.kind(j - 2) == "id":
            j -= 2
        computed = t.kind(j - 1) in (".", "?.") or t.at(j) in ("this", "super")
        parts = [t.at(x) for x in range(j, i + 1, 2)]
        parts = (["<computed>", t.at(i)] if computed else parts)
        name, line = ".".join(parts), t.line(j)
        who, at = self.caller()
        new = t.at(j - 1) == "new"
        self.calls.append((name, line, who, at, new, tuple(s for s in self.scopes if s.kind in ("function", "file"))))
        last, on = t.at(i), t.at(i - 2) if i > j else ""
        first = t.kind(p + 1)
        text = t.at(p + 1) if first in ("str", "tmpl") else ""
        static = first == "str" or (first == "tmpl" and t.kind(p + 2) != "{")
        if first == "tmpl" and not static:
            q = p + 2
            while q < t.end(p) and t.kind(q) in ("{", "tmpl"):
                q = t.end(q) + 1 if t.kind(q) == "{" else q + 1
            text = t.text[t.s[p + 1] : t.e[q - 1]]
        if last in VERBS and on and on not in CLIENTS and text.startswith("/"):
            self.add("route", text, "MOUNT" if last == "use" else last.upper(), line, owner=on, detail="express")
            if last == "use":
                child = next((x for x in range(t.end(p) - 1, p, -1) if t.kind(x) == "id"), -1)
                if child > 0:
                    self.add("mount", t.at(child), "express", line, owner=on, detail=text)
        if (len(parts) == 1 and last in ("fetch", "axios")) or (parts[0] == "axios" and last in VERBS):
            verb = last.upper() if parts[0] == "axios" and last in VERBS else self.method(p)
            if text:
                self.add("request", text, verb, line, owner=who, detail="static" if static else "dynamic")
            else:
                arg = t.text[t.s[p + 1] : t.e[self.value_end(p + 1)]] if t.end(p) > p + 1 else ""
                self.add("request", arg, verb, line, owner=who, detail="dynamic")
                own = self.function()
                if own.kind == "function" and own.name and arg in own.params:
                    self.wrappers[own.name] = verb
        elif len(parts) == 1 and text:
            self.uses.append((last, text, line, who))
        if on in STORES and last in STORE_VERBS and text:
            self.add("storage", text, on, line, owner=who, detail=last)
        if len(parts) == 1 and re.match(r"use[A-Z]", last):
            self.add("hook", last, "", line, owner=who)
        if len(parts) == 1 and last in TESTS and first in ("str", "tmpl"):
            self.add("test", text, last, line)
        if LOCATORS.fullmatch(last) and text:
            self.add("locator", text, last, line)
        if last == "require" and len(parts) == 1 and first == "str":
            of = self.names_before(j)
            self.add("import", text, "require", line, detail=of)

    def names_before(self, i: int) -> str:
        """What stands between `const` and the `=` before a call."""
        t, j = self.t, i - 1
        if t.kind(j) != "=":
            return ""
        e = j
        while j > 0 and self.word(j) not in ("const", "let", "var") and t.line(j) == t.line(i):
            j = t.m[j] if t.kind(j) in ("}", "]") and t.m[j] >= 0 else j - 1
        return " ".join(t.text[t.e[j] : t.s[e]].split()) if self.word(j) in ("const", "let", "var") else ""

    def method(self, p: int) -> str:
        """The verb in the options of a request."""
        t = self.t
        for j in range(p + 1, t.end(p)):
            if t.at(j) == "method" and t.kind(j + 1) == ":" and t.kind(j + 2) == "str":
                return t.at(j + 2).upper()
        return "GET"

    def commonjs(self) -> None:
        """module.exports = {a, b: c}, module.exports = a, module.exports.a = b, exports.a = b."""
        t = self.t
        for i in range(len(t.k)):
            if t.at(i) != "exports" or t.kind(i) != "id" or (t.kind(i - 1) == "." and t.at(i - 2) != "module"):
                continue
            line, j = t.line(i), i + 1
            if t.kind(j) == "." and t.kind(j + 2) == "=":
                self.add("export", t.at(j + 1), "commonjs", line, owner=t.at(j + 3) if t.kind(j + 3) == "id" and t.at(j + 3) not in ("function", "async", "class") else t.at(j + 1))
            elif t.kind(j) == "=" and t.kind(j + 1) == "id" and t.at(j + 1) not in ("function", "class", "async", "require", "new"):
                self.add("export", "default", "commonjs", line, owner=t.at(j + 1))
            elif t.kind(j) == "=" and t.kind(j + 1) == "{":
                x, end = j + 2, t.end(j + 1)
                while x < end:
                    if t.kind(x) == "id" and t.kind(x + 1) in (",", "}"):
                        self.add("export", t.at(x), "commonjs", line, owner=t.at(x))
                    elif t.kind(x) in ("id", "str") and t.kind(x + 1) == ":" and t.kind(x + 2) == "id" and t.kind(x + 3) in (",", "}"):
                        self.add("export", t.at(x), "commonjs", line, owner=t.at(x + 2))
                    while x < end and t.kind(x) != ",":
                        x = t.end(x) + 1 if t.kind(x) in tokens.OPENERS else x + 1
                    x += 1

    def finish(self) -> None:
        t = self.t
        if "exports" in t.text:
            self.commonjs()
        for name, line, who, at, new, scopes in self.calls:
            base = name.split(".", 1)[0]
            hidden = [s.kind for s in scopes if base in s.hidden]
            kind = "new" if new else "call" if not hidden else "local" if hidden == ["file"] and name == base else "shadowed"
            self.add("call", name, kind, line, at or None, owner=who)
        for name, text, line, who in self.uses:
            if name in self.wrappers:
                self.add("request", text, self.wrappers[name], line, owner=who, detail="wrapper")
        for start, end in t.docs:
            j = next_token(t, end)
            while t.at(j) in ("export", "default", "async", "abstract", "declare", "function", "class", "const", "let", "interface", "type", "enum", "*") or self.word(j) in MODIFIERS:
                j += 1
            body = " ".join(x.strip(" *\t\r") for x in t.text[start + 3 : end - 2].split("\n")).strip()
            line = t.text.count("\n", 0, start) + 1
            self.add("doc", t.at(j) if t.kind(j) == "id" else "", "jsdoc", line, detail=body)


def next_token(t: tokens.Stream, offset: int) -> int:
    """The first token that begins at or after an offset."""
    from bisect import bisect_left

    return bisect_left(t.s, offset)


_STATEMENTS = frozenset(n[3:] for n in dir(Script) if n.startswith("at_"))


def extract_script(path: str, text: str) -> list[Row]:
    """Facts of a TypeScript or JavaScript file."""
    return Script(path, text).run()
