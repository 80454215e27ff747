"""How fields of data models reach what is shown: observations of one script file, to be joined with the models later.

Observations are facts of record `lineage`. kind `alias`: a top-level variable of a named type; `output`: a function's
returned object takes a field of a typed parameter; `object`: a variable's object takes a field of another variable;
`derived`: a variable holds what a function returns; `component`, `rendered`: a component and the properties it shows;
`pass`: an element's attribute is given a field of a variable; `unsupported`: a field whose name is computed.
"""

from __future__ import annotations

from weftline.sources import tokens
from weftline.sources.rows import Row, row
from weftline.sources.script_facts import Script


class _Lineage(Script):
    def observe(self, kind: str, i: int, name: str = "", owner: str = "", detail: str = "") -> None:
        self.rows.append(row("lineage", name, kind, self.t.line(i), owner=owner, detail=detail))

    def parameters_of(self, p: int) -> list[tuple[str, str, list[str]]]:
        """Parameters in the bracket at p: (name, type, names of a pattern)."""
        t, out, j, end = self.t, [], p + 1, self.t.end(p)
        while j < end:
            names, after = self.bound(j)
            plain = t.kind(j) == "id"
            after += t.kind(after) == "?"
            kind = t.at(after + 1) if t.kind(after) == ":" and t.kind(after + 1) == "id" and t.kind(after + 2) in (",", ")", "=") else ""
            keys = [t.at(x) for x in range(j + 1, t.end(j)) if t.kind(x) == "id" and t.kind(x - 1) in ("{", ",")] if t.kind(j) == "{" else names
            out.append((t.at(j) if plain else "", kind, [] if plain else keys))
            while j < end and t.kind(j) != ",":
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
            j += 1
        return out

    def access(self, i: int, stop: tuple[str, ...]) -> str:
        """`a.b` that stands alone at i."""
        t = self.t
        return f"{t.at(i)}.{t.at(i + 2)}" if t.kind(i) == "id" and t.kind(i + 1) == "." and t.kind(i + 2) == "id" and t.kind(i + 3) in stop else ""

    def members(self, o: int):
        """(token of the key, its value, key or '') of an object literal at o."""
        t, j, end = self.t, o + 1, self.t.end(o)
        while j < end:
            if t.kind(j) == "[":
                yield j, t.end(j) + 2, ""
            elif t.kind(j) in ("id", "str") and t.kind(j + 1) == ":":
                yield j, j + 2, t.at(j)
            while j < end and t.kind(j) != ",":
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
            j += 1

    def function_like(self, name: str, at: int, p: int, b: int) -> None:
        """A named function of the file with its parameters at p and its body at b."""
        t, given = self.t, self.parameters_of(p)
        end = t.end(b) if t.kind(b) in tokens.OPENERS else self.value_end(b)
        models = {n: kind for n, kind, _ in given if n and kind}
        o = b + 1 if t.kind(b) == "(" and t.kind(b + 1) == "{" else -1
        j = b + 1
        while o < 0 and t.kind(b) == "{" and j < end:
            if t.at(j) == "return" and t.kind(j) == "id":
                o = j + 2 if t.kind(j + 1) == "(" and t.kind(j + 2) == "{" else j + 1 if t.kind(j + 1) == "{" else -1
                break
            j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
        if o > 0 and models:
            for k, v, key in self.members(o):
                got = self.access(v, (",", "}"))
                base = got.split(".")[0]
                if not key:
                    self.observe("unsupported", k, owner=name)
                elif base in models:
                    self.observe("output", k, f"{models[base]}.{got.split('.')[1]}", name, key)
        if name[:1].isupper() and any(t.k[x] == "jsxname" for x in range(b, end + 1)):
            self.observe("component", at, owner=name)
            first = given[0] if given else ("", "", [])
            for key in first[2]:
                self.observe("rendered", at, key, name)
            for x in range(b, end - 3):
                if first[0] and t.kind(x) == "{" and t.at(x + 1) == first[0] and t.kind(x + 2) == "." and t.kind(x + 3) == "id" and t.end(x) == x + 4:
                    self.observe("rendered", x, t.at(x + 3), name)

    def run(self) -> list[Row]:
        t, i, n = self.t, 0, len(self.t.k)
        while i < n:
            w = t.at(i) if t.kind(i) == "id" else ""
            if w == "function":
                j = i + 1 + (t.kind(i + 1) == "*")
                p = self.angle(j + 1)
                b = self.body(t.end(p) + 1, False) if t.kind(p) == "(" else -1
                if t.kind(j) == "id" and b > 0:
                    self.function_like(t.at(j), i, p, b)
                    i = t.end(b)
            elif w in ("const", "let", "var") and t.kind(i + 1) == "id":
                self.variable(i + 1)
                i += 1
            i = t.end(i) + 1 if t.kind(i) in tokens.OPENERS else i + 1
        self.elements()
        return self.rows

    def variable(self, i: int) -> None:
        t, name, j = self.t, self.t.at(i), i + 1
        if t.kind(j) == ":" and t.kind(j + 1) == "id" and t.kind(j + 2) in ("=", ";"):
            self.observe("alias", i, t.at(j + 1), name)
            j += 2
        elif t.kind(j) == ":":
            while j < len(t.k) and t.kind(j) not in ("=", ";"):
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
        if t.kind(j) != "=":
            return
        v = j + 1 + (t.at(j + 1) == "async")
        p = self.angle(v)
        if t.kind(p) == "(":
            b = self.body(t.end(p) + 1, True)
            if b > 0:
                self.function_like(name, i, p, b)
        elif t.kind(v) == "{":
            for k, value, key in self.members(v):
                got = self.access(value, (",", "}"))
                if key and got:
                    self.observe("object", k, got, name, key)
        elif t.kind(v) == "id" and t.kind(v + 1) == "(" and t.kind(v + 2) != ")":
            self.observe("derived", i, t.at(v), name)

    def elements(self) -> None:
        """Attributes that are given `a.b`, with the element they stand in."""
        t, depth, of = self.t, 0, {}
        for i in range(len(t.k)):
            k = t.k[i]
            depth += (k in tokens.OPENERS) - (k in (")", "]", "}"))
            if k == "jsxname":
                of[depth] = t.x[i]
                if t.x[i][:1].isupper():
                    self.observe("used", i, owner=t.x[i])
            elif k == "jsxattr" and t.kind(i + 1) == "{" and of.get(depth, "")[:1].isupper():
                got = self.access(i + 2, ("}",))
                if got:
                    self.observe("pass", i, got, of[depth], t.x[i])


def extract_lineage(path: str, text: str) -> list[Row]:
    """Lineage observations of a TypeScript or JavaScript file."""
    return _Lineage(path, text).run()
