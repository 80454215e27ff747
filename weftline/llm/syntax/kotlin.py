"""Kotlin source files. Line breaks that can end a statement are tokens of their own (NL)."""

from __future__ import annotations

import re

from weftline.llm.syntax.base import EOF, Fault, Parser, Tokens, deep, punctuation, words

RESERVED = words(
    "as break class continue do else false for fun if in interface is null object package return super this throw true try "
    "typealias typeof val var when while"
)
NAME = r"(?:[A-Za-z_\u00aa-\uffff\U00010000-\U0010ffff][A-Za-z0-9_\u00aa-\uffff\U00010000-\U0010ffff]*|`[^`\n\r]+`)"
ESC = r"\\(?:[tbrn'\"\\$]|u[0-9a-fA-F]{4})"
TOKEN = re.compile(
    r"(?P<ws>[ \t\f]+|//[^\n\r]*)|(?P<nl>\r\n?|\n)|(?P<com>/\*)|(?P<id>%s)"
    r"|(?P<num>0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[uU]?L?|0[bB][01](?:[01_]*[01])?[uU]?L?"
    r"|[0-9](?:[0-9_]*[0-9])?(?:\.[0-9](?:[0-9_]*[0-9])?(?:[eE][+-]?[0-9]+)?[fF]?|[eE][+-]?[0-9]+[fF]?|[fF]|[uU]?L?)|\.[0-9]+(?:[eE][+-]?[0-9]+)?[fF]?)"
    r"|(?P<raw>\"\"\")|(?P<quote>\")|(?P<chr>'(?:[^'\\\n\r]|%s)')|(?P<op>%s)"
    % (NAME, ESC, punctuation(
        "{ } ( ) [ ] ; , . .. ..< :: : -> = == != === !== < > <= >= && || ! !! ?. ?: ? ++ -- + - * / % += -= *= /= %= @ # & !in !is"
    ))
)
NESTED = re.compile(r"/\*|\*/")
PLAIN = re.compile(r"(?:[^\"\\$\n\r]|%s|\$(?![A-Za-z_{`]))+" % ESC)
RAW = re.compile(r"(?:[^\"$]|\$(?![A-Za-z_{`])|\"(?!\"\"))+")
SHORT = re.compile(r"\$(?:this\b|%s)" % NAME)
BEFORE = words(", ( [ { . ?. :: : -> = == != === !== < <= >= && || ! + - * / % += -= *= /= %= .. ..< ?: & in is as !in !is ; NL") | words(
    "else do fun val var class interface object package"
)
AFTER = words(". ?. ?: && || -> = == != === !== as .. ..< else , ) ]")


class Lexer:
    def __init__(self, text: str):
        self.x, self.n, self.t, self.i = text, len(text), Tokens(), 0

    def run(self) -> Tokens:
        if self.x.startswith("#!"):
            cut = self.x.find("\n")
            self.i = self.n if cut < 0 else cut
        deep(self.n)
        self.code(False)
        return self.t.close(self.n)

    def code(self, embedded: bool) -> None:
        """Tokens to the end, or to the brace that closes an embedded expression (which is passed)."""
        x, t, n = self.x, self.t, self.n
        stack: list[str] = []
        while self.i < n:
            i = self.i
            m = TOKEN.match(x, i)
            if not m:
                c = x[i]
                t.faults.append((i, "bad character literal" if c == "'" else f"unexpected character {c!r}"))
                self.i += 1
                continue
            kind, s, e = m.lastgroup, m.group(), m.end()
            self.i = e
            if kind == "ws":
                continue
            if kind == "nl":
                if not stack or stack[-1] == "{":
                    if t.kind and t.kind[-1] != "NL":
                        t.add("NL", i, e, 1)
                continue
            if kind == "com":
                depth, j = 1, e
                while depth:
                    c = NESTED.search(x, j)
                    if not c:
                        t.faults.append((i, "unterminated comment"))
                        self.i = n
                        return
                    depth += 1 if c.group() == "/*" else -1
                    j = c.end()
                self.i = j
                continue
            if kind in ("raw", "quote"):
                self.string(i, kind == "raw")
                continue
            if kind == "id":
                kind = s if s in RESERVED else "id"
            elif kind == "op":
                kind = s
                if s in ("!in", "!is") and e < n and (x[e].isalnum() or x[e] == "_"):
                    kind, e = "!", i + 1
                    self.i = e
                if kind in ("(", "[", "{"):
                    stack.append(kind)
                elif kind in (")", "]", "}"):
                    if not stack and embedded and kind == "}":
                        return
                    if stack:
                        stack.pop()
            elif kind == "num" and (e < n and (x[e].isalnum() or x[e] == "_") or s[0] == "0" and len(s) > 1 and s.replace("_", "").isdigit()):
                t.faults.append((i, "bad number"))
            t.add(kind, i, e, 0)
        if embedded:
            t.faults.append((n, "unterminated string template"))

    def string(self, at: int, raw: bool) -> None:
        x, t = self.x, self.t
        body = RAW if raw else PLAIN
        while True:
            m = body.match(x, self.i)
            if m:
                self.i = m.end()
            if self.i >= self.n:
                t.faults.append((at, "unterminated string"))
                break
            c = x[self.i]
            if c == '"':
                if raw:
                    while x.startswith('""""', self.i):
                        self.i += 1
                    self.i += 3
                else:
                    self.i += 1
                break
            if c == "$":
                if x.startswith("${", self.i):
                    t.add("str_${", self.i, self.i + 2, 0)
                    self.i += 2
                    self.code(True)
                    t.add("str_}", self.i - 1, self.i, 0)
                else:
                    self.i = SHORT.match(x, self.i).end()
                continue
            t.faults.append((self.i, "bad escape" if c == "\\" else "unterminated string"))
            if c == "\\":
                self.i += 1
                continue
            break
        t.add("str", at, self.i, 0)


def lex(text: str) -> Tokens:
    """Tokens without the line breaks that cannot end a statement."""
    t = Lexer(text).run()
    kind = t.kind
    out = Tokens()
    out.faults = t.faults
    n = len(kind)
    for i in range(n):
        k = kind[i]
        if k == "NL":
            before = out.kind[-1] if out.kind else "NL"
            after = kind[i + 1] if i + 1 < n else EOF
            ends = len(out.kind) > 1 and (out.kind[-2], before) in ((".", "*"), ("::", "class"))
            if (before in BEFORE and not ends) or after in AFTER:
                continue  # a break between operands joins them
        out.add(k, t.start[i], t.end[i], t.nl[i])
    return out


BINARY = {
    "||": 1, "&&": 2, "==": 3, "!=": 3, "===": 3, "!==": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "in": 5, "!in": 5, "is": 5,
    "!is": 5, "?:": 6, "id": 7, "..": 8, "..<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "as": 11,
}
ASSIGN = words("= += -= *= /= %=")
MODIFIERS = words(
    "public private protected internal abstract final open override sealed data enum annotation inner value inline noinline "
    "crossinline reified external suspend operator infix tailrec const lateinit vararg companion expect actual"
)
DECLARE = words("class interface object fun val var typealias")


class Kotlin(Parser):
    def __init__(self, tokens: Tokens, text: str):
        super().__init__(tokens)
        self.x = text
        self.no_lambda = False

    def word(self, i: int = 0) -> str:
        j = self.p + i
        return self.x[self.t.start[j] : self.t.end[j]] if j < len(self.k) and self.k[j] == "id" else ""

    def breaks(self) -> None:
        while self.at("NL"):
            self.p += 1

    def skip_ends(self) -> None:
        while self.at("NL", ";"):
            self.p += 1

    def end(self) -> None:
        if self.at("NL", ";"):
            self.p += 1
        elif not self.at("}", EOF, "str_}"):
            self.fail("expected the end of the statement")

    def name(self) -> None:
        self.need("id")

    # top level
    def program(self) -> None:
        self.skip_ends()
        while self.at("@") and self.word(1) == "file":
            self.file_annotation()
            self.skip_ends()
        if self.at("package"):
            self.statements_head(self.package)
        self.statements(self.top)

    def statements_head(self, rule) -> None:
        p = self.p
        try:
            rule()
        except Fault as f:
            self.recover(f, p, ())

    def declaration_end(self) -> None:
        """After a declaration of a file or class; one with a body needs no separator."""
        if self.k[self.p - 1] != "}" or self.at("NL", ";"):
            self.end()

    def package(self) -> None:
        self.need("package")
        self.dotted()
        self.end()

    def file_annotation(self) -> None:
        self.p += 2
        self.need(":")
        if self.at("["):
            self.balanced()
        else:
            self.user_type()
            if self.at("("):
                self.arguments()

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def top(self) -> None:
        if self.at("NL", ";"):
            self.skip_ends()
            return
        if self.word() == "import":
            self.p += 1
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            if self.eat("as"):
                self.name()
            self.end()
            return
        self.declaration()
        self.declaration_end()

    def modifiers(self) -> None:
        while True:
            if self.at("@"):
                self.annotation()
                self.breaks()
            elif self.word() in MODIFIERS and self.modifier_here():
                self.p += 1
                self.breaks()
            else:
                return

    def modifier_here(self) -> bool:
        i = 1
        while self.peek(i) == "NL":
            i += 1
        nxt = self.peek(i)
        if nxt in DECLARE or nxt == "@":
            return True
        if self.word() == "companion" and nxt == "object":
            return True
        return nxt == "id" and (self.word(i) in MODIFIERS or self.word(i) in ("constructor", "init", "get", "set"))

    def annotation(self) -> None:
        self.need("@")
        if self.at("id") and self.peek() == ":" and self.word() in ("field", "get", "set", "param", "property", "receiver", "delegate", "setparam", "file", "all"):
            self.p += 2
        if self.at("["):
            self.balanced()
            return
        self.user_type()
        if self.at("(") and self.adjacent(self.p):
            self.arguments()

    def declaration_here(self) -> bool:
        p = self.p
        try:
            self.modifiers()
            k = self.k[self.p]
            if k == "fun":
                return True
            if k == "object":
                return self.peek() == "id"
            return k in DECLARE
        finally:
            self.p = p

    def declaration(self) -> None:
        self.modifiers()
        k = self.k[self.p]
        if k in ("class", "interface"):
            self.class_()
        elif k == "object":
            companion = self.word(-1) == "companion"
            self.p += 1
            if not self.eat("id") and not companion:
                self.fail("expected a name")
            self.supertypes()
            self.optional_body()
        elif k == "fun":
            if self.peek() == "interface":
                self.p += 1
                self.class_()
            else:
                self.function()
        elif k in ("val", "var"):
            self.property()
        elif k == "typealias":
            self.p += 1
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
        else:
            self.fail("expected a declaration")

    def after_breaks(self, *kinds: str) -> bool:
        """Step over line breaks if one of the kinds stands after them."""
        p = self.p
        self.breaks()
        if self.k[self.p] in kinds:
            return True
        self.p = p
        return False

    def class_(self) -> None:
        self.p += 1
        self.name()
        self.type_parameters()
        p = self.p
        self.breaks()
        self.modifiers_before_constructor()
        if self.word() == "constructor":
            self.p += 1
        elif self.p != p and not self.at("("):
            self.p = p
        if self.at("("):
            self.p += 1
            self.listed(self.class_parameter, ")")
        self.supertypes()
        self.where()
        self.optional_body()

    def modifiers_before_constructor(self) -> None:
        p = self.p
        while self.at("@") or self.word() in ("private", "protected", "internal", "public"):
            if self.at("@"):
                self.annotation()
            else:
                self.p += 1
        if self.word() != "constructor":
            self.p = p

    def class_parameter(self) -> None:
        self.modifiers()
        while self.word() in MODIFIERS and self.peek() in ("id", "val", "var"):
            self.p += 1
        if not self.eat("val"):
            self.eat("var")
        self.name()
        self.need(":")
        self.type()
        if self.eat("="):
            self.expression()

    def supertypes(self) -> None:
        if self.after_breaks(":"):
            self.p += 1
            while True:
                self.breaks()
                while self.at("@"):
                    self.annotation()
                self.type()
                if self.at("("):
                    self.arguments()
                if self.word() == "by":
                    self.p += 1
                    self.no_lambda = True  # the brace that follows is the body
                    try:
                        self.expression()
                    finally:
                        self.no_lambda = False
                if not self.eat(","):
                    return

    def where(self) -> None:
        p = self.p
        self.breaks()
        if self.word() == "where":
            self.p += 1
            while True:
                while self.at("@"):
                    self.annotation()
                self.name()
                self.need(":")
                self.type()
                if not self.eat(","):
                    return
                self.breaks()
        else:
            self.p = p

    def optional_body(self) -> None:
        if self.after_breaks("{"):
            self.class_body()

    def class_body(self) -> None:
        self.need("{")
        p = self.p
        self.skip_ends()
        if self.at("id") and self.enum_entry_here():
            while self.at("id", "@") and not self.declaration_here():
                while self.at("@"):
                    self.annotation()
                    self.breaks()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.class_body()
                self.breaks()
                if not self.eat(","):
                    break
                self.breaks()
            self.breaks()
            if not self.at("}"):
                self.need(";")
        else:
            self.p = p
        self.statements(self.member, "}")
        self.need("}")

    def enum_entry_here(self) -> bool:
        if self.word() in ("init", "constructor") and self.peek() in ("{", "("):
            return False
        if self.declaration_here():
            return False
        return self.peek() in (",", "(", "}", ";", "{") or (self.peek() == "NL" and self.peek(2) in ("}", ",", ";"))

    def member(self) -> None:
        if self.at("NL", ";"):
            self.skip_ends()
            return
        if self.word() == "init" and (self.peek() == "{" or (self.peek() == "NL" and self.peek(2) == "{")):
            self.p += 1
            self.breaks()
            self.block()
            self.end()
            return
        p = self.p
        self.modifiers()
        while self.word() in ("private", "protected", "internal", "public") and self.word(1) == "constructor":
            self.p += 1
        if self.word() == "constructor" and self.peek() == "(":
            self.p += 2
            self.listed(self.class_parameter, ")")
            if self.eat(":"):
                if not (self.eat("this") or self.eat("super")):
                    self.fail("expected this or super")
                self.arguments()
            if self.at("{"):
                self.block()
            self.end()
            return
        self.p = p
        self.declaration()
        self.declaration_end()

    def function(self) -> None:
        self.need("fun")
        self.type_parameters()
        self.receiver_and_name()
        self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.eat(":"):
            self.type()
        self.where()
        if self.after_breaks("{"):
            self.block()
        elif self.eat("="):
            self.breaks()
            self.expression()

    def receiver_and_name(self) -> None:
        if self.at("id") and self.peek() in ("(", "<") and self.plain_name():
            self.p += 1
            return
        if self.at("("):
            self.balanced()
            self.eat("?")
            self.need(".")
            self.name()
            return
        while self.at("@"):
            self.annotation()
        while True:
            self.name()
            if self.at("<"):
                p = self.p
                if not self.attempt(self.type_arguments) or not self.at(".", "?.", "?"):
                    self.p = p
                    return
            self.eat("?")
            if not (self.eat(".") or self.eat("?.")):
                return

    def plain_name(self) -> bool:
        if self.peek() == "(":
            return True
        p = self.p
        self.p += 1
        ok = self.attempt(self.type_arguments) and self.at("(")
        self.p = p
        return ok

    def parameter(self) -> None:
        while self.at("@"):
            self.annotation()
        while self.word() in ("vararg", "noinline", "crossinline") and self.peek() == "id":
            self.p += 1
        self.name()
        self.need(":")
        self.type()
        if self.eat("="):
            self.expression()

    def property(self) -> None:
        self.p += 1
        self.type_parameters()
        if self.at("("):
            self.p += 1
            self.listed(self.variable, ")")
        else:
            self.receiver_and_name()
            if self.eat(":"):
                self.type()
        self.where()
        if self.eat("="):
            self.breaks()
            self.expression()
        elif self.word() == "by":
            self.p += 1
            self.breaks()
            self.expression()
        for _ in range(2):
            p = self.p
            self.skip_ends()
            while self.at("@") or (self.word() in ("private", "protected", "internal", "public", "inline", "override") and self.word(1) in ("get", "set")):
                if self.at("@"):
                    if not self.attempt(self.annotation):
                        break
                else:
                    self.p += 1
            if self.word() in ("get", "set") and (self.peek() in ("(", "NL", ";", "}", "=", "{", EOF)):
                if self.word() == "set" and self.peek() not in ("(", "NL", ";", "}", EOF):
                    self.p = p
                    return
                self.accessor()
            else:
                self.p = p
                return

    def accessor(self) -> None:
        self.p += 1
        if self.eat("("):
            if not self.eat(")"):
                while self.at("@"):
                    self.annotation()
                self.name()
                if self.eat(":"):
                    self.type()
                self.eat(",")
                self.need(")")
            if self.eat(":"):
                self.type()
            if self.after_breaks("{"):
                self.block()
            else:
                self.need("=")
                self.breaks()
                self.expression()

    def variable(self) -> None:
        while self.at("@"):
            self.annotation()
        self.name()
        if self.eat(":"):
            self.type()

    # types
    def type_parameters(self) -> None:
        if self.eat("<"):

            def one():
                while self.at("@"):
                    self.annotation()
                while (self.word() in ("out", "reified") and self.peek() == "id") or self.at("in"):
                    self.p += 1
                self.name()
                if self.eat(":"):
                    self.type()

            self.listed(one, ">")

    def type_arguments(self) -> None:
        self.need("<")

        def one():
            if self.eat("*"):
                return
            if self.at("in") or (self.word() == "out" and self.peek() in ("id", "(")):
                self.p += 1
            self.type()

        self.listed(one, ">")

    def type(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.word() == "suspend" and self.peek() in ("(", "id"):
            self.p += 1
        if self.at("("):
            self.p += 1

            def one():
                if self.at("id") and self.peek() == ":":
                    self.p += 2
                self.type()

            self.listed(one, ")")
            if self.eat("->"):
                self.type()
                return
            while self.at("?", "!!"):
                self.p += 1
        else:
            self.user_type()
        if self.at(".") and self.peek() == "(":
            self.p += 1
            self.type()
            return
        if self.eat("&"):
            self.type()

    def user_type(self) -> None:
        while True:
            self.name()
            if self.at("<"):
                self.type_arguments()
            if self.at(".") and self.peek() == "id":
                self.p += 1
                continue
            break
        while self.at("?"):
            self.p += 1
        if self.at("?.") and self.peek() == "(":
            self.p += 1
            self.type()

    # statements
    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.need("}")

    def statement(self) -> None:
        if self.at("NL", ";"):
            self.skip_ends()
            return
        self.statement_inner()
        self.end()

    def statement_inner(self) -> None:
        while self.at("id") and self.peek() == "@" and self.adjacent(self.p + 1) and not self.peek(2) in ("id",) or self.label_here():
            self.p += 2
            self.breaks()
        if self.at("for"):
            self.for_()
        elif self.at("while"):
            self.p += 1
            self.condition()
            self.control_body(optional=True)
        elif self.at("do"):
            self.p += 1
            self.breaks()
            self.control_body()
            self.breaks()
            self.need("while")
            self.condition()
        elif self.declaration_here() and not (self.at("fun") and self.peek() == "("):
            self.declaration()
        else:
            while self.at("@"):
                self.annotation()
                self.breaks()
            kind = self.binary(0)
            if self.k[self.p] in ASSIGN:
                if not kind:
                    self.fail("cannot assign")
                self.p += 1
                self.breaks()
                self.expression()

    def label_here(self) -> bool:
        return self.at("id") and self.peek() == "@" and self.adjacent(self.p + 1) and not self.adjacent(self.p + 2)

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def control_body(self, optional: bool = False) -> None:
        if self.after_breaks("{"):
            self.block()
        elif optional and self.at(";"):
            return
        else:
            self.breaks()
            self.statement_inner()

    def for_(self) -> None:
        self.p += 1
        self.need("(")
        while self.at("@"):
            self.annotation()
        if self.eat("("):
            self.listed(self.variable, ")")
        else:
            self.variable()
        self.need("in")
        self.expression()
        self.need(")")
        self.control_body(optional=True)

    # expressions; the result tells whether it can be assigned to
    def expression(self) -> bool:
        while self.at("@"):
            self.annotation()
        return self.binary(0)

    def binary(self, least: int) -> bool:
        kind = self.unary()
        while True:
            k = self.k[self.p]
            level = BINARY.get(k, 0)
            if not level or level <= least:
                return kind
            if k == "id" and self.word() in ("where", "by") and self.peek() != "(":
                return kind
            self.p += 1
            self.breaks()
            if k in ("is", "!is"):
                self.type()
            elif k == "as":
                self.eat("?")
                self.type()
            else:
                self.binary(level)
                if level == 4 and BINARY.get(self.k[self.p]) == 4:
                    self.fail("comparisons cannot be chained")
            kind = False

    def unary(self) -> bool:
        k = self.k[self.p]
        if k in ("-", "+", "!", "++", "--"):
            self.p += 1
            self.unary()
            return False
        if k == "!!":
            self.p += 1
            self.unary()
            return False
        if k == "@":
            self.annotation()
            return self.unary()
        if self.label_here():
            self.p += 2
            return self.unary()
        return self.postfix()

    def arguments(self) -> None:
        self.need("(")

        def one():
            while self.at("@"):
                self.annotation()
            if self.at("id") and self.peek() == "=":
                self.p += 2
            self.eat("*")
            self.expression()

        self.listed(one, ")")

    def postfix(self) -> bool:
        kind = self.primary()
        while True:
            k = self.k[self.p]
            if k in (".", "?."):
                self.p += 1
                self.breaks()
                if self.at("("):
                    self.p += 1
                    self.expression()
                    self.need(")")
                elif self.at("class"):
                    self.p += 1
                else:
                    self.name()
                kind = True
            elif k == "::":
                self.p += 1
                if not self.eat("class"):
                    self.name()
                kind = False
            elif k == "?" and self.peek() == "::":
                self.p += 1
            elif k == "(":
                self.arguments()
                self.trailing_lambda()
                kind = False
            elif k == "[":
                self.p += 1
                self.listed(self.expression, "]")
                kind = True
            elif k == "{" and self.lambda_allowed():
                self.lambda_()
                kind = False
            elif k in ("++", "--"):
                self.p += 1
                kind = False
            elif k == "!!":
                self.p += 1
                kind = True
            elif k == "<" and self.attempt(self.call_type_arguments):
                kind = False
            else:
                return kind

    def lambda_allowed(self) -> bool:
        return not self.no_lambda and self.k[self.p - 1] in ("id", ">", ")", "]", "}")

    def call_type_arguments(self) -> None:
        self.type_arguments()
        if not self.at("(", "{", ".", "?.", "::", ")", ",", "NL", EOF, "]", ";", "}"):
            self.fail("no call")

    def trailing_lambda(self) -> None:
        if self.no_lambda:
            return
        if self.at("{"):
            self.lambda_()
        elif self.label_here() and self.peek(2) == "{":
            self.p += 2
            self.lambda_()

    def lambda_(self) -> None:
        self.need("{")
        p = self.p
        if not self.attempt(self.lambda_parameters):
            self.p = p
        self.statements(self.statement, "}")
        self.need("}")

    def lambda_parameters(self) -> None:
        self.breaks()
        while not self.eat("->"):
            if self.eat("("):
                self.listed(self.variable, ")")
                if self.eat(":"):
                    self.type()
            else:
                self.variable()
            self.breaks()
            if not self.at("->"):
                self.need(",")
                self.breaks()

    def primary(self) -> bool:
        k = self.k[self.p]
        if k == "id":
            self.p += 1
            return True
        if k in ("num", "chr", "true", "false", "null"):
            self.p += 1
            return False
        if k == "str":
            self.p += 1
            return False
        if k == "str_${":
            while self.eat("str_${"):
                self.statements(self.statement, "str_}")
                self.need("str_}")
            self.need("str")
            return False
        if k in ("this", "super"):
            self.p += 1
            if k == "super" and self.at("<"):
                self.type_arguments()
            if self.at("@") and self.adjacent(self.p):
                self.p += 1
                self.name()
            return False
        if k == "(":
            self.p += 1
            kind = self.expression()
            self.need(")")
            return kind
        if k == "[":
            self.p += 1
            self.listed(self.expression, "]")
            return False
        if k == "{":
            self.lambda_()
            return False
        if k == "if":
            self.p += 1
            self.condition()
            if self.at(";") and self.peek() == "else" or self.at("else"):
                self.eat(";")
            else:
                self.control_body()
            p = self.p
            self.breaks()
            self.eat(";")
            if self.at("else") and self.peek() != "->":  # with an arrow it is a branch of when
                self.p += 1
                self.control_body()
            else:
                self.p = p
            return False
        if k == "when":
            self.when()
            return False
        if k == "try":
            self.try_()
            return False
        if k == "object":
            self.p += 1
            self.supertypes()
            self.breaks()
            self.class_body()
            return False
        if k == "fun":
            self.p += 1
            if not self.at("("):
                self.type()
                self.need(".")
            self.need("(")

            def one():
                self.name()
                if self.eat(":"):
                    self.type()

            self.listed(one, ")")
            if self.eat(":"):
                self.type()
            if self.after_breaks("{"):
                self.block()
            else:
                self.need("=")
                self.expression()
            return False
        if k == "throw":
            self.p += 1
            self.expression()
            return False
        if k in ("return", "break", "continue"):
            self.p += 1
            if self.at("@") and self.adjacent(self.p):
                self.p += 1
                self.name()
            if k == "return" and not self.at("NL", ";", "}", ")", "]", ",", EOF, "else", "str_}", "?:"):
                self.expression()
            return False
        if k == "::":
            self.p += 1
            if not self.eat("class"):
                self.name()
            return False
        self.fail("expected an expression")
        return False

    def when(self) -> None:
        self.p += 1
        if self.eat("("):
            while self.at("@"):
                self.annotation()
            if self.eat("val"):
                self.variable()
                self.need("=")
            self.expression()
            self.need(")")
        self.breaks()
        self.need("{")
        while True:
            self.skip_ends()
            if self.eat("}"):
                return
            if self.eat("else"):
                pass
            else:
                while True:
                    self.breaks()
                    if self.at("in", "!in"):
                        self.p += 1
                        self.expression()
                    elif self.at("is", "!is"):
                        self.p += 1
                        self.type()
                    else:
                        self.expression()
                    if not self.eat(",") or self.at("->"):
                        break
                if self.at("if"):
                    self.p += 1
                    self.expression()
            self.breaks()
            self.need("->")
            self.control_body()
            if not self.at("NL", ";", "}", "else"):
                self.fail("expected the end of the branch")

    def try_(self) -> None:
        self.p += 1
        self.breaks()
        self.block()
        handled = False
        while True:
            p = self.p
            self.breaks()
            if self.word() == "catch":
                self.p += 1
                self.need("(")
                while self.at("@"):
                    self.annotation()
                self.name()
                self.need(":")
                self.type()
                self.eat(",")
                self.need(")")
                self.breaks()
                self.block()
                handled = True
            elif self.word() == "finally":
                self.p += 1
                self.breaks()
                self.block()
                return
            else:
                self.p = p
                if not handled:
                    self.fail("try without catch")
                return


def parse(text: str) -> list[tuple[int, str]]:
    """Faults of a Kotlin file: (offset, what)."""
    if text.startswith("\ufeff"):
        text = text[1:]
    return Kotlin(lex(text), text).run()
