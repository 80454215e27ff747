"""Facts of Java, Kotlin and Rust files, from tokens with brackets.

Declarations are read where they may stand: in the file and in the bodies of types (and, in Kotlin and Rust, of
functions), so words in comments, texts, calls and types are never taken for them.
"""

from __future__ import annotations

from weftline.sources import tokens
from weftline.sources.rows import Row, literal, row

JAVA_MODIFIERS = frozenset("public private protected static final abstract synchronized native default sealed strictfp transient volatile non".split())
KOTLIN_MODIFIERS = frozenset(
    "public private internal protected open abstract sealed data enum annotation inner value companion const lateinit override suspend inline "
    "operator infix tailrec external expect actual noinline crossinline vararg final fun".split()
)
NOT_CALLED = frozenset("if for while switch catch return new super this else synchronized when fun fn match loop in as throw assert try do constructor where is".split())
TYPES = frozenset("class interface enum record object impl trait".split())


class Braces:
    """A scan with a stack of bodies; `owners` are the declarations that hold the present place."""

    language = ""

    def __init__(self, text: str):
        self.t = tokens.plain(text, self.language)
        self.rows: list[Row] = []
        self.stack: list[tuple[int, int, str, str]] = []  # (last token, opening bracket, name, kind)

    def add(self, *cells, **more) -> None:
        self.rows.append(row(*cells, **more))

    def owner(self) -> str:
        return ".".join(x[2] for x in self.stack if x[2])

    def holder(self) -> str:
        """The kind of the nearest declaration."""
        return self.stack[-1][3] if self.stack else "file"

    def caller(self) -> str:
        return next((x[2] for x in reversed(self.stack) if x[3] in ("method", "fun", "function")), "")

    def symbol(self, i: int, name: str, kind: str, end: int, exported: bool, detail: str = "") -> None:
        self.add("symbol", name, kind, self.t.line(i), self.t.end_line(min(end, len(self.t.k) - 1)), exported, self.owner(), detail)

    def angle(self, i: int) -> int:
        """After type arguments that begin at i, or i."""
        t, depth, j = self.t, 0, i
        if t.kind(i) != "<":
            return i
        while j < len(t.k):
            k = t.k[j]
            if k == "<":
                depth += 1
            elif k == ">" and t.kind(j - 1) != "-":
                depth -= 1
                if not depth:
                    return j + 1
            elif k in (";", "{", "}", ")") and self.language != "rust":
                return i
            elif k in ("(", "["):
                j = t.end(j)
            j += 1
        return i

    def run(self) -> list[Row]:
        t, i = self.t, 0
        while i < len(t.k):
            while self.stack and self.stack[-1][0] < i:
                self.stack.pop()
            to = self.declaration(i) if t.k[i] in ("id", "@", "#", "<") else i
            if to > i:
                i = to
                continue
            if t.k[i] == "str":
                self.rows.append(literal(t.x[i], t.line(i), self.caller()))
            elif t.k[i] == "id":
                self.call(i)
            elif t.k[i] == "{":
                self.stack.append((t.end(i), i, "", self.block_kind()))
            i += 1
        return self.rows

    def block_kind(self) -> str:
        return "block"

    def declaration(self, i: int) -> int:
        raise NotImplementedError

    def open_body(self, b: int, name: str, kind: str) -> int:
        self.stack.append((self.t.end(b), b, name, kind))
        return b + 1

    def call(self, i: int) -> None:
        t = self.t
        p = self.angle(i + 1) if t.kind(i + 1) == "<" and self.language != "rust" else i + 1
        if t.kind(p) != "(" or t.at(i) in NOT_CALLED or t.at(i - 1) in ("fun", "fn", "class", "record"):
            return
        j = i
        while t.kind(j - 1) in (".", "::", "?.") and t.kind(j - 2) == "id":
            j -= 2
        parts = [t.at(x) for x in range(j, i + 1, 2)]
        sign = "::" if self.language == "rust" and t.kind(j + 1) == "::" else "."
        name = sign.join(parts) if t.kind(j - 1) not in (".", "?.") else "<computed>." + t.at(i)
        self.add("call", name, "new" if t.at(j - 1) == "new" else "call", t.line(j), owner=self.caller())

    def dotted(self, i: int) -> tuple[str, int]:
        """A dotted name at i, with a closing star, and what follows it."""
        t, parts = self.t, [self.t.at(i)]
        while t.kind(i + 1) == "." and t.kind(i + 2) in ("id", "*"):
            parts.append(t.at(i + 2))
            i += 2
        return ".".join(x.strip("`") for x in parts), i + 1


class Java(Braces):
    language = "java"

    def declaration(self, i: int) -> int:
        t, holder = self.t, self.holder()
        if holder not in TYPES and holder != "file" and not (t.at(i) in ("class", "interface", "enum", "record") and t.kind(i + 1) == "id" and t.kind(i - 1) != "."):
            return i
        if t.at(i) == "package" and holder == "file":
            name, j = self.dotted(i + 1)
            self.add("package", name, "package", t.line(i))
            return j
        if t.at(i) == "import" and holder == "file":
            static = t.at(i + 1) == "static"
            name, j = self.dotted(i + 1 + static)
            self.add("import", name, "wildcard" if name.endswith("*") else "named", t.line(i), detail="static" if static else "")
            return j
        if t.kind(i - 1) not in ("", ";", "{", "}", ",", ")") and holder in TYPES:
            return i
        j, mods = i, []
        while j < len(t.k):
            if t.kind(j) == "@" and t.at(j + 1) != "interface":
                _, j = self.dotted(j + 1)
                j = t.end(j) + 1 if t.kind(j) == "(" else j
            elif t.at(j) in JAVA_MODIFIERS or t.kind(j) == "-":
                mods.append(t.at(j))
                j += 1
            else:
                break
        public = "public" in mods
        j += t.kind(j) == "@"
        if t.at(j) in ("class", "interface", "enum", "record") and t.kind(j + 1) == "id" and (t.at(j) != "record" or t.kind(self.angle(j + 2)) == "("):
            kind, name, b = t.at(j), t.at(j + 1), j + 2
            while b < len(t.k) and t.kind(b) not in ("{", ";"):
                b = t.end(b) + 1 if t.kind(b) == "(" else b + 1
            if t.kind(b) != "{":
                return i
            self.symbol(i, name, kind, t.end(b), public, " ".join(t.text[t.s[j] : t.s[b]].split()))
            if kind == "record":
                self.fields_of(self.angle(j + 2), name)
            return self.open_body(b, name, kind)
        if holder not in TYPES:
            return i
        if holder == "enum" and t.kind(j) == "id" and t.kind(j + 1) in (",", "(", ";", "}", "{") and t.kind(i - 1) in ("{", ","):
            return i  # a constant
        j = self.angle(j)
        k, last = j, -1  # a type and a name, or for constructors a name alone
        while k < len(t.k):
            if t.kind(k) == "id":
                last = k
                k = self.angle(k + 1)
            elif t.kind(k) in (".", "[", "]", "?", "&", "..."):
                k += 1
            elif t.kind(k) == "@":
                k += 2
            else:
                break
        if last < 0 or t.at(last) in NOT_CALLED or t.at(j) in ("return", "new", "throw", "else"):
            return i
        if t.kind(k) == "(" and last == k - 1:
            b = t.end(k) + 1
            while b < len(t.k) and t.kind(b) not in ("{", ";", "}"):
                b = t.end(b) + 1 if t.kind(b) == "(" else b + 1
            if t.kind(b) not in ("{", ";"):
                return i
            self.symbol(i, t.at(last), "method" if last > j else "constructor", t.end(b) if t.kind(b) == "{" else b, public, " ".join(t.text[t.s[j] : t.e[t.end(k)]].split()))
            return self.open_body(b, t.at(last), "method") if t.kind(b) == "{" else b
        if t.kind(k) in ("=", ";", ",") and last > j:
            self.add("model_field", t.at(last), "field", t.line(last), owner=self.owner().rsplit(".", 1)[-1], detail=" ".join(t.text[t.s[j] : t.s[last]].split()))
            while k < len(t.k) and t.kind(k) not in (";", "}"):
                if t.kind(k) == "id":
                    self.call(k)
                elif t.kind(k) == "str":
                    self.rows.append(literal(t.x[k], t.line(k)))
                elif t.kind(k) == "{":  # a body in the initial value: its calls belong to the type
                    break
                k += 1
            return k
        return i

    def fields_of(self, p: int, owner: str) -> None:
        t, j = self.t, p + 1
        while j < t.end(p):
            start, last = j, -1
            while j < t.end(p) and t.kind(j) != ",":
                last = j if t.kind(j) == "id" else last
                j = self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else t.end(j) + 1 if t.kind(j) == "(" else j + 1
            if last > start:
                self.add("model_field", t.at(last), "component", t.line(last), owner=owner, detail=" ".join(t.text[t.s[start] : t.s[last]].split()))
            j += 1


class Kotlin(Braces):
    language = "kotlin"

    def declaration(self, i: int) -> int:
        t = self.t
        if t.kind(i - 1) in (".", "?.", "::") or t.at(i - 1) == "::":
            return i
        if t.at(i) == "package" and not self.stack and t.kind(i + 1) == "id":
            name, j = self.dotted(i + 1)
            self.add("package", name, "package", t.line(i))
            return j
        if t.at(i) == "import" and not self.stack and t.kind(i + 1) == "id":
            name, j = self.dotted(i + 1)
            alias = t.at(j + 1) if t.at(j) == "as" else ""
            self.add("import", name, "wildcard" if name.endswith("*") else "named", t.line(i), detail=alias)
            return j + 2 * bool(alias)
        j, mods = i, []
        while j < len(t.k):
            if t.kind(j) == "@":
                j += 2
                if t.kind(j) == ":":
                    j += 2
                j = self.dotted(j - 1)[1]
                j = t.end(j) + 1 if t.kind(j) == "(" and t.s[j] == t.e[j - 1] else j
            elif t.at(j) in KOTLIN_MODIFIERS and (t.kind(j + 1) in ("id", "@")) and not (t.at(j) == "fun" and t.at(j + 1) != "interface"):
                mods.append(t.at(j))
                j += 1
            else:
                break
        exported, w = not {"private", "internal"} & set(mods), t.at(j)
        if w in ("class", "interface", "object") and (t.kind(j + 1) == "id" or (w == "object" and "companion" in mods)) and t.kind(j) == "id":
            named = t.kind(j + 1) == "id"
            name = t.at(j + 1).strip("`") if named else "Companion"
            b = self.angle(j + 1 + named)
            head_end = b
            while t.at(b) in KOTLIN_MODIFIERS or t.at(b) == "constructor" or t.kind(b) == "@":
                b += 1
            if t.kind(b) == "(":
                self.properties(b, name)
                b = t.end(b) + 1
                head_end = b
            if t.kind(b) == ":":  # supertypes, with calls and delegates
                b += 1
                while b < len(t.k) and t.kind(b) != "{":
                    if b > head_end + 1 and t.line(b) > t.line(b - 1) and t.kind(b - 1) not in (",", ":", "<", "by", "&") and t.at(b - 1) != "by" and t.kind(b) not in (",",) and t.at(b) not in ("by", "where"):
                        break
                    b = t.end(b) + 1 if t.kind(b) == "(" else self.angle(b) if t.kind(b) == "<" and self.angle(b) > b else b + 1
                head_end = b
            kind = "enum" if "enum" in mods else w
            if t.kind(b) == "{" and (b == head_end or t.line(b) == t.line(b - 1)):
                self.symbol(i, name, kind, t.end(b), exported, " ".join(mods))
                return self.open_body(b, name, "class" if kind == "enum" else kind)
            self.symbol(i, name, kind, head_end - 1, exported, " ".join(mods))
            return max(head_end, j + 1)
        if w == "fun" and t.kind(j + 1) in ("id", "<"):
            p = self.angle(j + 1)
            start = p
            while p < len(t.k) and t.kind(p) != "(":  # a receiver may stand before the name
                if t.kind(p) not in ("id", ".", "?", "<", "?.", "@"):
                    return i
                p = self.angle(p) if t.kind(p) == "<" and self.angle(p) > p else p + 1
            if p <= start or t.kind(p - 1) != "id":
                return i
            name, b = t.at(p - 1).strip("`"), t.end(p) + 1
            if t.kind(b) == ":":
                b += 1
                while t.kind(b) in ("id", ".", "?", "(", "->", "*"):
                    nxt = self.angle(b + 1)
                    if t.kind(b) == "id" and t.line(nxt) > t.line(nxt - 1) and t.kind(nxt) not in (".", "->", "{", "="):
                        b = nxt
                        break
                    b = t.end(b) + 1 if t.kind(b) == "(" else nxt if t.kind(b) == "id" else b + 1
            holder = self.holder()
            kind = "method" if holder in TYPES else "fun"
            if t.kind(b) == "{":
                self.symbol(i, name, kind, t.end(b), exported)
                return self.open_body(b, name, kind)
            if t.kind(b) == "=":
                end = self.line_end(b + 1)
                self.symbol(i, name, kind, end, exported)
                self.stack.append((end, b, name, kind))
                return b + 1
            self.symbol(i, name, kind, b - 1, exported)
            return b
        if w in ("val", "var") and self.holder() in (*TYPES, "file") and (t.kind(j + 1) == "id" or t.kind(j + 1) == "<"):
            p = self.angle(j + 1)
            while t.kind(p + 1) == "." and t.kind(p + 2) == "id":
                p += 2
            name = t.at(p).strip("`")
            if self.holder() == "file":
                self.symbol(i, name, "property", p, exported)
            else:
                e = p + 2
                while t.kind(p + 1) == ":" and t.kind(e) in ("id", ".", "?") and t.at(e) != "by":
                    nxt = self.angle(e + 1)
                    if t.line(nxt) > t.line(nxt - 1):
                        e = nxt
                        break
                    e = nxt
                self.add("model_field", name, w, t.line(p), owner=self.owner().rsplit(".", 1)[-1], detail=" ".join(t.text[t.s[p + 2] : t.e[e - 1]].split()) if t.kind(p + 1) == ":" and e > p + 2 else "")
            return p + 1
        return i

    def properties(self, p: int, owner: str) -> None:
        t, j = self.t, p + 1
        while j < t.end(p):
            start = j
            while j < t.end(p) and t.kind(j) != ",":
                if t.at(j) in ("val", "var") and t.kind(j + 1) == "id" and t.kind(j + 2) == ":":
                    e = j + 3
                    while e < t.end(p) and t.kind(e) not in (",", "="):
                        e = t.end(e) + 1 if t.kind(e) == "(" else self.angle(e) if t.kind(e) == "<" and self.angle(e) > e else e + 1
                    self.add("model_field", t.at(j + 1), t.at(j), t.line(j), owner=owner, detail=" ".join(t.text[t.s[j + 3] : t.e[e - 1]].split()))
                    j = e
                    continue
                if t.kind(j) == "id" and t.kind(j + 1) == "(":
                    self.call(j)
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else self.angle(j) if t.kind(j) == "<" and self.angle(j) > j else j + 1
            j = max(j + 1, start + 1)

    def line_end(self, i: int) -> int:
        """The last token of an expression body."""
        t = self.t
        while i < len(t.k):
            nxt = t.end(i) + 1 if t.kind(i) in tokens.OPENERS else i + 1
            if nxt >= len(t.k) or t.kind(nxt) in ("}", ")"):
                return nxt - 1
            if t.line(nxt) > t.end_line(nxt - 1) and t.kind(nxt) not in (".", "?.", "?", ":", "&&", "||", "+", "else") and t.at(nxt) != "else" and t.kind(nxt - 1) in tokens._AFTER_VALUE:
                return nxt - 1
            i = nxt
        return len(t.k) - 1


class Rust(Braces):
    language = "rust"

    def declaration(self, i: int) -> int:
        t = self.t
        if t.kind(i) == "#" and t.kind(i + 1) in ("[", "!"):
            p = i + 1 + (t.kind(i + 1) == "!")
            return t.end(p) + 1 if t.kind(p) == "[" else i
        if t.kind(i - 1) in (".", "::"):
            return i
        j, public = i, False
        if t.at(j) == "pub":
            public = True
            j = t.end(j + 1) + 1 if t.kind(j + 1) == "(" else j + 1
        while t.at(j) in ("const", "async", "unsafe", "extern", "default") and (t.kind(j + 1) == "id" or t.kind(j + 1) == "str") and t.at(j + 1) in ("fn", "async", "unsafe", "extern", "trait", "impl", "mod") or (t.at(j) == "extern" and t.kind(j + 1) == "str"):
            j += 1 + (t.kind(j + 1) == "str")
        w, name = t.at(j), t.at(j + 1)
        if w == "use" and t.kind(j) == "id":
            end = j + 1
            while end < len(t.k) and t.kind(end) != ";":
                end += 1
            for path, alias in self.tree(j + 1, end):
                self.add("import", path, "wildcard" if path.endswith("*") else "use", t.line(i), exported=public, detail=alias)
            return end + 1
        if w in ("struct", "enum", "union", "trait", "mod") and t.kind(j + 1) == "id":
            b = j + 2
            while b < len(t.k) and t.kind(b) not in ("{", ";"):
                b = t.end(b) + 1 if t.kind(b) in ("(", "[") else b + 1
            kind = "module" if w == "mod" else w
            self.symbol(i, name, kind, t.end(b) if t.kind(b) == "{" else b, public, "inline" if w == "mod" and t.kind(b) == "{" else "")
            if t.kind(b) != "{":
                if w == "mod":
                    self.add("module", name, "file", t.line(i), owner=self.owner())
                return b
            if w == "trait":
                bounds = [t.at(x) for x in range(j + 2, b) if t.kind(x) == "id" and t.kind(j + 2) == ":" and t.kind(x + 1) != "::" and t.at(x) not in ("where",)]
                for x in bounds:
                    self.add("relation", x, "supertrait", t.line(i), owner=name)
            if w == "struct":
                self.fields(b, name)
                return t.end(b) + 1
            if w == "enum":
                self.variants(b, name)
                return t.end(b) + 1
            return self.open_body(b, name, kind)
        if w == "impl" and t.kind(j) == "id":
            b = self.angle(j + 1)
            start, of = b, -1
            while b < len(t.k) and t.kind(b) not in ("{", ";") and t.at(b) != "where":
                of = b if t.at(b) == "for" else of
                b = self.angle(b) if t.kind(b) == "<" and self.angle(b) > b else t.end(b) + 1 if t.kind(b) in ("(", "[") else b + 1
            last = lambda lo, hi: next((t.at(x) for x in reversed(range(lo, hi)) if t.kind(x) == "id" and t.kind(x - 1) != "<" and not self.inside(lo, x)), "")
            trait = last(start, of) if of >= 0 else ""
            target = last(of + 1 if of >= 0 else start, b)
            while b < len(t.k) and t.kind(b) not in ("{", ";"):
                b = t.end(b) + 1 if t.kind(b) in ("(", "[") else b + 1
            if t.kind(b) != "{":
                return i
            self.symbol(i, target, "impl", t.end(b), False, trait)
            if trait:
                self.add("relation", trait, "implements", t.line(i), owner=target)
            return self.open_body(b, target, "impl")
        if w == "fn" and t.kind(j + 1) == "id":
            b = self.angle(j + 2)
            b = t.end(b) + 1 if t.kind(b) == "(" else b
            while b < len(t.k) and t.kind(b) not in ("{", ";"):
                b = t.end(b) + 1 if t.kind(b) in ("(", "[") else b + 1
            kind = "method" if self.holder() in ("impl", "trait") else "function"
            self.symbol(i, name, kind, t.end(b) if t.kind(b) == "{" else b, public)
            return self.open_body(b, name, kind) if t.kind(b) == "{" else b
        if w in ("const", "static") and t.kind(j + 1) == "id" and (t.kind(j + 2) == ":" or name == "mut") and self.holder() != "function" and self.holder() != "method":
            k = j + 1 + (name == "mut")
            self.symbol(i, t.at(k), "const", k, public)
            return k + 1
        if w == "type" and t.kind(j + 1) == "id" and t.kind(self.angle(j + 2)) in ("=", ";", ":") and self.holder() not in ("function", "method", "block"):
            self.symbol(i, name, "type", j + 1, public)
            return j + 2
        if w == "macro_rules" and t.kind(j + 1) == "!":
            self.symbol(i, t.at(j + 2), "macro", t.end(j + 3), False)
            return t.end(j + 3) + 1
        return i

    def inside(self, lo: int, x: int) -> bool:
        """x stands in type arguments that begin after lo."""
        j = lo
        while j < x:
            to = self.angle(j) if self.t.kind(j) == "<" else j + 1
            if to > x:
                return True
            j = max(to, j + 1)
        return False

    def tree(self, i: int, end: int) -> list[tuple[str, str]]:
        """The paths of a use tree with their aliases."""
        t, prefix, out = self.t, [], []
        while i < end:
            if t.kind(i) == "{":
                j, last = t.end(i), i + 1
                x = i + 1
                while x <= j:
                    if t.kind(x) == "{":
                        x = t.end(x)
                    elif t.kind(x) == "," or x == j:
                        if x > last:
                            out += [("::".join(prefix + [p]), a) for p, a in self.tree(last, x)]
                        last = x + 1
                    x += 1
                return out
            if t.at(i) == "as":
                return [("::".join(prefix), t.at(i + 1))]
            if t.kind(i) in ("id", "*"):
                prefix.append(t.at(i))
            i += 1
        return [("::".join(prefix), "")] if prefix else []

    def fields(self, b: int, owner: str) -> None:
        t, j, end = self.t, b + 1, self.t.end(b)
        while j < end:
            while t.kind(j) == "#":
                j = t.end(j + 1) + 1
            public = t.at(j) == "pub"
            if public:
                j = t.end(j + 1) + 1 if t.kind(j + 1) == "(" else j + 1
            at, e = j, j + 2
            while e < end and t.kind(e) != ",":
                e = t.end(e) + 1 if t.kind(e) in ("(", "[") else self.angle(e) if t.kind(e) == "<" and self.angle(e) > e else e + 1
            if t.kind(at) == "id" and t.kind(at + 1) == ":":
                self.add("model_field", t.at(at), "field", t.line(at), exported=public, owner=owner, detail=" ".join(t.text[t.s[at + 2] : t.e[e - 1]].split()))
            j = e + 1

    def variants(self, b: int, owner: str) -> None:
        t, j, end = self.t, b + 1, self.t.end(b)
        while j < end:
            while t.kind(j) == "#":
                j = t.end(j + 1) + 1
            if t.kind(j) == "id":
                self.add("model_field", t.at(j), "variant", t.line(j), owner=owner)
            while j < end and t.kind(j) != ",":
                j = t.end(j) + 1 if t.kind(j) in tokens.OPENERS else j + 1
            j += 1


def extract_java(path: str, text: str) -> list[Row]:
    return Java(text).run()


def extract_kotlin(path: str, text: str) -> list[Row]:
    return Kotlin(text).run()


def extract_rust(path: str, text: str) -> list[Row]:
    return Rust(text).run()
