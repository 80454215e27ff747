"""Python 3.13 source files. Line ends and indentation are tokens: NEWLINE, INDENT, DEDENT."""

from __future__ import annotations

import re

from weftline.llm.syntax.base import CLOSERS, EOF, OPENERS, LexFault, Parser, Tokens, deep, punctuation, words

RESERVED = words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield"
)
NAME = r"[^\W\d]\w*"
DIGITS = r"[0-9](?:_?[0-9])*"
TOKEN = re.compile(
    r"(?P<ws>[ \t\f]+|#[^\n\r]*|\\(?:\r\n|\n|\r))|(?P<nl>\r\n|\n|\r)"
    r"|(?P<str>(?P<pre>[rRbBuUfF]{0,2})(?P<q>\"\"\"|'''|\"|'))|(?P<id>%s)"
    r"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:%s)?\.%s(?:[eE][+-]?%s)?[jJ]?|%s\.?(?:[eE][+-]?%s)?[jJ]?)|(?P<op>%s)"
    % (NAME, DIGITS, DIGITS, DIGITS, DIGITS, DIGITS, punctuation(
        "{ } ( ) [ ] ; , : . ... := = -> + - * / // % @ & | ^ ~ << >> ** < > <= >= == != += -= *= /= //= %= @= &= |= ^= >>= <<= **= !"
    ))
)
INDENT = re.compile(r"[ \t\f]*")
LINE = re.compile(r"[^\n\r]*")
PREFIX = re.compile(r"[rRbBuUfF]{0,2}")
# a line that begins so cannot stand in brackets
STATEMENT = re.compile(
    r"[ \t\f]*(?:def|class|import|return|raise|while|with|try|del|global|nonlocal|pass|break|continue|assert|except|finally|elif)\b"
)
BODY = {
    '"': re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*'), "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*'), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*"),
}
PREFIXES = words("r u b f br rb fr rf")
BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^{}\n]+\}))")
BAD_BYTES = re.compile(r"\\x(?![0-9a-fA-F]{2})")


class Lexer:
    def __init__(self, text: str):
        self.x, self.n, self.t, self.i = text, len(text), Tokens(), 0
        self.stack: list[str] = []
        self.nested = 0
        self.strict = False

    def run(self) -> Tokens:
        t = self.t
        if "\x00" in self.x:
            t.faults.append((self.x.index("\x00"), "null byte"))
        deep(self.n)
        self.lines()
        return t.close(self.n)

    def lines(self) -> None:
        x, t, n = self.x, self.t, self.n
        levels: list[tuple[int, int]] = [(0, 0)]
        fresh = True
        while True:
            if fresh:
                m = INDENT.match(x, self.i)
                c = x[m.end() : m.end() + 1]
                if c and c not in "#\n\r":
                    self.indent(m.group(), m.end(), levels)
                self.i = m.end()
                fresh = False
            if self.i >= n:
                break
            kind = self.token()
            if kind == "nl" and self.stack and STATEMENT.match(x, self.i):
                t.note(self.i, "bracket was never closed")
                while self.stack:
                    t.add(OPENERS[self.stack.pop()], self.i - 1, self.i - 1, 0)
            if kind == "nl" and not self.stack:
                if t.kind and t.kind[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    t.add("NEWLINE", self.i - 1, self.i, 0)
                fresh = True
        if self.stack:
            t.faults.append((n, "bracket was never closed"))
        if x.endswith("\\") and t.kind:
            t.faults.append((n, "unexpected end after a backslash"))
        if t.kind and t.kind[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
            t.add("NEWLINE", n, n, 0)
        for _ in levels[1:]:
            t.add("DEDENT", n, n, 0)

    def indent(self, space: str, at: int, levels: list[tuple[int, int]]) -> None:
        """Columns with tabs of eight and of one must agree on the order of lines."""
        wide = narrow = 0
        for c in space:
            if c == " ":
                wide, narrow = wide + 1, narrow + 1
            elif c == "\t":
                wide, narrow = (wide // 8 + 1) * 8, narrow + 1
            else:
                wide = narrow = 0
        top = levels[-1]
        if wide == top[0]:
            if narrow != top[1]:
                self.t.faults.append((at, "inconsistent tabs"))
            return
        if wide > top[0]:
            if narrow <= top[1]:
                self.t.faults.append((at, "inconsistent tabs"))
            levels.append((wide, narrow))
            self.t.add("INDENT", at, at, 0)
            return
        while levels[-1][0] > wide:
            levels.pop()
            self.t.add("DEDENT", at, at, 0)
        if levels[-1][0] != wide:
            self.t.faults.append((at, "unindent does not match"))
        elif levels[-1][1] != narrow:
            self.t.faults.append((at, "inconsistent tabs"))

    def token(self) -> str:
        """Read one token (or blank); its kind."""
        x, i = self.x, self.i
        m = TOKEN.match(x, i)
        if not m:
            self.t.faults.append((i, f"unexpected character {x[i]!r}"))
            self.i += 1
            return "bad"
        kind, e = m.lastgroup, m.end()
        if kind in ("pre", "q"):
            kind = "str"
        self.i = e
        if kind in ("ws", "nl"):
            return kind
        if kind == "str":
            prefix = m["pre"].lower()
            if prefix and prefix not in PREFIXES:
                self.t.faults.append((i, "bad string prefix"))
            if "f" in prefix:
                self.fstring(i, m["q"], "r" in prefix)
            else:
                self.string(i, m["q"], prefix)
            return kind
        s = m.group()
        if kind == "id":
            kind = s if s in RESERVED else "id"
        elif kind == "op":
            kind = s
            if kind in OPENERS:
                self.stack.append(kind)
            elif kind in CLOSERS:
                kind = self.closer(kind, i)
                if not kind:
                    return "bad"
        elif e < self.n and (x[e].isalnum() or x[e] == "_") and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", x[e : e + 5]):
            self.t.faults.append((i, "bad number"))
        elif len(s) > 1 and s[0] == "0" and s.replace("_", "").isdigit() and s.strip("0_"):
            self.t.faults.append((i, "leading zeros"))
        self.t.add(kind, i, e, 0)
        return kind

    def closer(self, kind: str, i: int) -> str:
        """A closing bracket as the token to add. One that does not match is noted, and the stream repaired: brackets inside
        its own are closed, it stands for the one due, or it is left out ('')."""
        stack = self.stack
        if stack and OPENERS[stack[-1]] == kind:
            stack.pop()
            return kind
        self.t.note(i, f"unmatched {kind}")
        if not stack:
            return ""
        if not any(OPENERS[b] == kind for b in stack):
            return OPENERS[stack.pop()]
        while OPENERS[stack[-1]] != kind:
            self.t.add(OPENERS[stack.pop()], i, i, 0)
        stack.pop()
        return kind

    def string(self, at: int, q: str, prefix: str) -> None:
        m = BODY[q].match(self.x, self.i)
        e = m.end()
        if not self.x.startswith(q, e):
            self.t.faults.append((at, "unterminated triple-quoted string" if len(q) == 3 else "unterminated string"))
            self.i = self.n if len(q) == 3 else e
            self.t.add("str", at, self.i, 0)
            return
        if "\\" in m.group() and "r" not in prefix:
            plain = m.group().replace("\\\\", "")
            if (BAD_BYTES if "b" in prefix else BAD_ESCAPE).search(plain):
                self.t.faults.append((at, "bad escape"))
        if "b" in prefix and not m.group().isascii():
            self.t.faults.append((at, "bytes with other than ASCII"))
        self.i = e + len(q)
        self.t.add("bytes" if "b" in prefix else "str", at, self.i, 0)

    def fstring(self, at: int, q: str, raw: bool) -> None:
        t, body, stack = self.t, self.i, self.stack
        n, faults = len(t.kind), len(t.faults)
        t.add("fs_open", at, body, 0)
        self.nested += 1
        try:
            self.literal(at, q, raw, False)
        except LexFault as f:
            if self.nested > 1:
                raise
            # a field ran to the end of the text: go on after the string's quote or first line; from here on no field passes these
            end = self.x.find(q, body) if len(q) == 3 else LINE.match(self.x, body).end()
            self.i = self.n if end < 0 else end + len(q) * (len(q) == 3)
            t.undo(n, faults, self.i)
            t.note(f.offset if f.offset < self.i else at, f.what)
            t.add("str", at, self.i, 0)
            self.stack, self.strict = stack, True
            return
        finally:
            self.nested -= 1
        if self.x.startswith(q, self.i):
            self.i += len(q)
        t.add("fs_close", self.i - len(q), self.i, 0)

    def literal(self, at: int, q: str, raw: bool, spec: bool) -> None:
        """Plain characters and replacement fields, up to the quote or, noted, the end of the line; in a format spec up to `}`."""
        x = self.x
        while True:
            if self.i >= self.n:
                raise LexFault(at, "unterminated f-string")
            c = x[self.i]
            if x.startswith(q, self.i):
                if spec:
                    self.t.note(self.i, "f-string: expected }")
                return
            if c in "\n\r" and len(q) == 1:
                self.t.note(at, "unterminated f-string")
                return
            if c == "\\":
                if not raw and x.startswith("\\N{", self.i):
                    end = x.find("}", self.i)
                    self.i = self.n if end < 0 else end + 1
                elif x[self.i + 1 : self.i + 2] in ("{", "}"):
                    self.i += 1
                else:
                    if not raw and BAD_ESCAPE.match(x, self.i):
                        self.t.faults.append((self.i, "bad escape"))
                    self.i += 2
            elif c == "{":
                if not spec and x.startswith("{{", self.i):
                    self.i += 2
                else:
                    self.field(at, q, raw)
            elif c == "}":
                if spec:
                    return
                if x.startswith("}}", self.i):
                    self.i += 2
                else:
                    self.t.note(self.i, "f-string: single }")
                    self.i += 1
            else:
                self.i += 1

    def field(self, at: int, q: str, raw: bool) -> None:
        x = self.x
        self.t.add("fs_{", self.i, self.i + 1, 0)
        self.i += 1
        outer, self.stack = self.stack, []
        while True:
            if self.i >= self.n:
                raise LexFault(at, "unterminated f-string")
            c = x[self.i]
            if self.strict:
                quote = PREFIX.match(x, self.i).end()
                if x.startswith(q, quote):
                    self.i = quote
                    self.t.note(quote, "f-string: expected }")
                    break
                if len(q) == 1 and c in "\n\r":
                    break
            if c == "}" and self.stack and "{" not in self.stack:
                self.t.note(self.i, "unmatched }")
                while self.stack:
                    self.t.add(OPENERS[self.stack.pop()], self.i, self.i, 0)
            if not self.stack:
                if c == "}":
                    break
                if c == "!" and not x.startswith("!=", self.i):
                    break
                if c == ":":
                    break
                if c == "=" and re.match(r"=\s*[}!:]", x[self.i : self.i + 40]) and x[self.i - 1] not in "=!<>":
                    self.i = re.compile(r"=\s*").match(x, self.i).end()
                    break
            self.token()
        self.stack = outer
        if x.startswith("!", self.i):
            if re.match(r"![rsa]\s*[}:]", x[self.i : self.i + 20]):
                self.i = re.compile(r"![rsa]\s*").match(x, self.i).end()
            else:
                self.t.note(self.i, "f-string: bad conversion")
                while self.i < self.n and x[self.i] not in "}:\n\r" and not x.startswith(q, self.i):
                    self.i += 1
        if x.startswith(":", self.i):
            self.i += 1
            self.t.add("fs_:", self.i - 1, self.i, 0)
            self.literal(at, q, raw, True)
        if x.startswith("}", self.i):
            self.i += 1
        self.t.add("fs_}", self.i - 1, self.i, 0)


COMPARE = words("< > <= >= == != in is not")
BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
AUGMENTED = words("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")
COMPOUND = words("if while for try with def class async @")
NO, ONE, MANY, STARRED = 0, 1, 2, 3


class Python(Parser):

    def __init__(self, tokens: Tokens, text: str):
        super().__init__(tokens)
        self.x = text

    def word(self, i: int = 0) -> str:
        j = self.p + i
        return self.x[self.t.start[j] : self.t.end[j]] if j < len(self.k) and self.k[j] == "id" else ""

    def recover(self, fault, began: int, until: tuple) -> None:
        """Panic mode: go on after the end of the logical line, over an indented block that belongs to it."""
        self.faults.append((self.t.start[min(fault.at, self.last)], fault.what))
        self.p = max(self.p, began)
        while self.p < self.last and self.k[self.p] not in ("NEWLINE", "DEDENT", "INDENT"):
            self.p += 1
        if self.at("NEWLINE"):
            self.p += 1
        if self.at("INDENT"):
            depth = 0
            while self.p < self.last:
                depth += self.at("INDENT") - self.at("DEDENT")
                self.p += 1
                if depth == 0:
                    return
        elif self.at("DEDENT") and "DEDENT" not in until:
            self.p += 1

    def program(self) -> None:
        self.statements(self.statement)

    def block(self) -> None:
        self.need(":")
        if self.eat("NEWLINE"):
            if not self.eat("INDENT"):
                self.fail("expected an indented block")
            self.statements(self.statement, "DEDENT")
            self.need("DEDENT")
        else:
            self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if self.eat(";"):
                if self.eat("NEWLINE"):
                    return
                continue
            self.need("NEWLINE")
            return

    def statement(self) -> None:
        k = self.k[self.p]
        rule = self.RULES.get(k)
        if rule:
            rule(self)
        elif k == "NEWLINE":
            self.p += 1
        elif k == "INDENT":
            self.fail("unexpected indent")
        elif self.word() == "match" and self.match_here():
            self.match()
        else:
            self.simple_line()

    def if_(self) -> None:
        self.p += 1
        self.named()
        self.block()
        while self.eat("elif"):
            self.named()
            self.block()
        if self.eat("else"):
            self.block()

    def while_(self) -> None:
        self.p += 1
        self.named()
        self.block()
        if self.eat("else"):
            self.block()

    def for_(self) -> None:
        self.need("for")
        if self.targets() == NO:
            self.fail("cannot assign")
        self.need("in")
        self.star_expressions()
        self.block()
        if self.eat("else"):
            self.block()

    def try_(self) -> None:
        self.p += 1
        self.block()
        handled = False
        while self.eat("except"):
            handled = True
            self.eat("*")
            bare = self.at(":")
            if not bare:
                self.test()
                if self.eat("as"):
                    self.need("id")
                elif self.at(","):
                    self.fail("multiple exception types must be parenthesized")
            self.block()
            if bare:
                break
        if handled and self.eat("else"):
            self.block()
        if self.eat("finally"):
            self.block()
        elif not handled:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.need("with")
        if not (self.at("(") and self.attempt(self.with_grouped)):
            self.with_items(":")
        self.block()

    def with_grouped(self) -> None:
        self.need("(")
        self.with_items(")")
        self.need(")")
        if not self.at(":"):
            self.fail("no group")

    def with_items(self, close: str) -> None:
        while True:
            self.test()
            if self.eat("as") and self.star_target() == NO:
                self.fail("cannot assign")
            if not self.eat(",") or (close == ")" and self.at(close)):
                return

    def async_(self) -> None:
        self.p += 1
        if self.at("def", "for", "with"):
            self.RULES[self.k[self.p]](self)
        else:
            self.fail("unexpected")

    def decorated(self) -> None:
        while self.eat("@"):
            self.named()
            self.need("NEWLINE")
        if not self.at("def", "class", "async"):
            self.fail("expected a definition")
        self.statement()

    def def_(self) -> None:
        self.need("def")
        self.need("id")
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat("->"):
            self.test()
        self.block()

    def class_(self) -> None:
        self.need("class")
        self.need("id")
        self.type_parameters()
        if self.at("("):
            self.call()
        self.block()

    def type_parameters(self) -> None:
        if self.eat("["):

            def one():
                if not self.eat("*"):
                    self.eat("**")
                self.need("id")
                if self.eat(":"):
                    self.test()
                if self.eat("="):
                    self.eat("*")
                    self.test()

            self.listed(one, "]")

    def parameters(self, close: str, typed: bool) -> None:
        default = star = slash = False
        while not self.at(close):
            if self.eat("/"):
                if slash or star:
                    self.fail("unexpected /")
                slash = True
            elif self.eat("**"):
                self.need("id")
                if typed and self.eat(":"):
                    self.test()
                self.eat(",")
                if not self.at(close):
                    self.fail("nothing may follow **")
                return
            elif self.eat("*"):
                if star:
                    self.fail("* twice")
                star = True
                default = False
                if self.eat("id"):
                    if typed and self.eat(":"):
                        self.eat("*")
                        self.test()
                elif not self.at(",") or self.peek() in (close, "**"):
                    self.fail("names must follow *")
            else:
                self.need("id")
                if typed and self.eat(":"):
                    self.test()
                if self.eat("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default after one with a default")
            if not self.eat(","):
                return

    # match
    def match_here(self) -> bool:
        """A line that begins with match and ends with a colon before a block of cases."""
        if self.peek() in ("=", ".", ",", ")", ":", "NEWLINE", "EOF") or self.peek() in AUGMENTED:
            return False
        i = self.p + 1
        while self.k[i] not in ("NEWLINE", EOF):
            i += 1
        return self.k[i - 1] == ":" and self.k[i + 1] == "INDENT"

    def match(self) -> None:
        self.p += 1
        self.star_expressions()
        self.need(":")
        self.need("NEWLINE")
        self.need("INDENT")
        while not self.eat("DEDENT"):
            if self.word() != "case":
                self.fail("expected case")
            self.p += 1
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block()

    def patterns(self) -> None:
        self.pattern_as(True)
        while self.eat(","):
            if self.at(":", "if"):
                return
            self.pattern_as(True)

    def pattern_as(self, star: bool = False) -> None:
        if star and self.eat("*"):
            self.need("id")
            return
        self.pattern()
        while self.eat("|"):
            self.pattern()
        if self.eat("as"):
            self.need("id")

    def pattern(self) -> None:
        k = self.k[self.p]
        if k in ("num", "-"):
            self.eat("-")
            self.need("num")
            if self.at("+", "-"):
                self.p += 1
                self.need("num")
        elif k in ("str", "bytes", "fs_open"):
            self.strings()
        elif k in ("None", "True", "False"):
            self.p += 1
        elif k in ("(", "["):
            self.p += 1
            close = OPENERS[k]
            self.listed(lambda: self.pattern_as(True), close)
        elif k == "{":
            self.p += 1

            def item():
                if self.eat("**"):
                    self.need("id")
                    return
                self.pattern()
                self.need(":")
                self.pattern_as()

            self.listed(item, "}")
        elif k == "id":
            self.p += 1
            while self.eat("."):
                self.need("id")
            if self.eat("("):

                def argument():
                    if self.at("id") and self.peek() == "=":
                        self.p += 2
                    self.pattern_as()

                self.listed(argument, ")")
        else:
            self.fail("expected a pattern")

    # simple statements
    def simple(self) -> None:
        k = self.k[self.p]
        rule = self.SIMPLE.get(k)
        if rule:
            rule(self)
            return
        if self.word() == "type" and self.peek() == "id":
            self.p += 2
            self.type_parameters()
            self.need("=")
            self.test()
            return
        kind = self.star_expressions()
        k = self.k[self.p]
        if k == "=":
            while self.eat("="):
                if kind == NO or kind == STARRED:
                    self.fail("cannot assign")
                kind = self.yield_or_expressions()
        elif k in AUGMENTED:
            if kind != ONE:
                self.fail("cannot assign")
            self.p += 1
            self.yield_or_expressions()
        elif k == ":":
            if kind != ONE:
                self.fail("cannot annotate")
            self.p += 1
            self.test()
            if self.eat("="):
                self.yield_or_expressions()

    def yield_or_expressions(self) -> int:
        if self.at("yield"):
            self.yield_()
            return NO
        return self.star_expressions()

    def pass_(self) -> None:
        self.p += 1

    def del_(self) -> None:
        self.p += 1
        kind = self.star_expressions()
        if kind == NO or kind == STARRED:
            self.fail("cannot delete")

    def return_(self) -> None:
        self.p += 1
        if not self.at("NEWLINE", ";"):
            self.star_expressions()

    def raise_(self) -> None:
        self.p += 1
        if not self.at("NEWLINE", ";"):
            self.test()
            if self.eat("from"):
                self.test()

    def global_(self) -> None:
        self.p += 1
        self.need("id")
        while self.eat(","):
            self.need("id")

    def assert_(self) -> None:
        self.p += 1
        self.test()
        if self.eat(","):
            self.test()

    def import_(self) -> None:
        self.p += 1
        while True:
            self.dotted()
            if self.eat("as"):
                self.need("id")
            if not self.eat(","):
                return

    def dotted(self) -> None:
        self.need("id")
        while self.eat("."):
            self.need("id")

    def from_(self) -> None:
        self.p += 1
        dots = False
        while self.at(".", "..."):
            self.p += 1
            dots = True
        if not dots or not self.at("import"):
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return

        def one():
            self.need("id")
            if self.eat("as"):
                self.need("id")

        if self.eat("("):
            if self.at(")"):
                self.fail("expected a name")
            self.listed(one, ")")
            return
        one()
        while self.eat(","):
            one()

    # expressions; the result tells what it is as a target
    def targets(self) -> int:
        kind = self.star_target()
        while self.eat(","):
            if self.at("in", "="):
                return MANY if kind else NO
            other = self.star_target()
            kind = MANY if kind and other else NO
        return kind

    def star_target(self) -> int:
        self.eat("*")
        return self.unary_target()

    def unary_target(self) -> int:
        return self.postfix()

    def star_expressions(self) -> int:
        kind = self.star_expression()
        if not self.at(","):
            return kind
        good = kind != NO
        while self.eat(","):
            if self.ends_list():
                break
            good &= self.star_expression() != NO
        return MANY if good else NO

    def ends_list(self) -> bool:
        return self.k[self.p] in ("NEWLINE", "=", ")", "]", "}", ":", ";", EOF, "fs_}", "fs_:") or self.k[self.p] in AUGMENTED

    def star_expression(self) -> int:
        if self.eat("*"):
            return STARRED if self.binary(0) else (STARRED if self.at(",", "NEWLINE", ")", "]", "}", ";", "for", "fs_}") else NO)
        return self.named()

    def named(self) -> int:
        if self.at("id") and self.peek() == ":=":
            self.p += 2
            self.test()
            return NO
        return self.test()

    def test(self) -> int:
        if self.eat("lambda"):
            self.parameters(":", False)
            self.need(":")
            self.test()
            return NO
        kind = self.or_()
        if self.eat("if"):
            self.or_()
            if not self.at("else"):
                self.fail("expected else")
            self.p += 1
            self.test()
            return NO
        return kind

    def or_(self) -> int:
        kind = self.not_()
        while self.at("or", "and"):
            self.p += 1
            self.not_()
            kind = NO
        return kind

    def not_(self) -> int:
        if self.eat("not"):
            self.not_()
            return NO
        kind = self.binary(0)
        while self.k[self.p] in COMPARE:
            if self.eat("is"):
                self.eat("not")
            elif self.eat("not"):
                self.need("in")
            else:
                self.p += 1
            self.binary(0)
            kind = NO
        return kind

    def binary(self, least: int) -> int:
        kind = self.unary()
        while True:
            level = BINARY.get(self.k[self.p], 0)
            if not level or level <= least:
                return kind
            self.p += 1
            self.binary(level)
            kind = NO

    def unary(self) -> int:
        if self.at("+", "-", "~"):
            self.p += 1
            self.unary()
            return NO
        if self.eat("await"):
            self.postfix()
            kind = NO
        else:
            kind = self.postfix()
        if self.eat("**"):
            self.unary()
            return NO
        return kind

    def postfix(self) -> int:
        kind = self.atom()
        while True:
            if self.eat("."):
                self.need("id")
                kind = ONE
            elif self.at("("):
                self.call()
                kind = NO
            elif self.eat("["):
                if self.at("]"):
                    self.fail("expected an index")
                self.listed(self.subscript, "]")
                kind = ONE
            else:
                return kind

    def subscript(self) -> None:
        if self.eat("*"):
            self.binary(0)
            return
        if not self.at(":"):
            self.named()
        if self.eat(":"):
            if not self.at(":", "]", ","):
                self.test()
            if self.eat(":") and not self.at("]", ","):
                self.test()

    def call(self) -> None:
        self.need("(")
        keyword = unpacked = False
        first = True
        while not self.eat(")"):
            if self.eat("*"):
                if unpacked:
                    self.fail("iterable unpacking after keyword unpacking")
                self.test()
            elif self.eat("**"):
                self.test()
                unpacked = True
            elif self.at("id") and self.peek() == "=":
                self.p += 2
                self.test()
                keyword = True
            else:
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
                    if not (first and self.at(")")) and not self.at(")"):
                        self.fail("generator must be parenthesized")
                    if not first:
                        self.fail("generator must be parenthesized")
                elif keyword or unpacked:
                    self.fail("positional argument after keyword argument")
            first = False
            if self.eat(")"):
                return
            self.need(",")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.eat("async")
            self.need("for")
            if self.targets() == NO:
                self.fail("cannot assign")
            self.need("in")
            self.or_()
            while self.eat("if"):
                self.condition()

    def condition(self) -> None:
        if self.at("id") and self.peek() == ":=":
            self.named()
        elif self.at("lambda"):
            self.test()
        else:
            self.or_()

    def strings(self) -> None:
        kinds = set()
        while self.at("str", "bytes", "fs_open"):
            kinds.add("bytes" if self.at("bytes") else "str")
            if self.eat("fs_open"):
                self.fields("fs_close")
            else:
                self.p += 1
        if len(kinds) > 1:
            self.fail("bytes and text mixed")

    def fields(self, close: str) -> None:
        while not self.at(close):
            self.need("fs_{")
            if self.at("yield"):
                self.yield_()
            else:
                self.star_expressions()
            if self.eat("fs_:"):
                self.fields("fs_}")
            self.need("fs_}")
        if close == "fs_close":
            self.p += 1

    def yield_(self) -> None:
        self.need("yield")
        if self.eat("from"):
            self.test()
        elif not self.ends_list():
            self.star_expressions()

    def atom(self) -> int:
        k = self.k[self.p]
        if k == "id":
            self.p += 1
            return ONE
        if k in ("num", "None", "True", "False", "..."):
            self.p += 1
            return NO
        if k in ("str", "bytes", "fs_open"):
            self.strings()
            return NO
        if k == "(":
            self.p += 1
            if self.eat(")"):
                return MANY
            if self.at("yield"):
                self.yield_()
                self.need(")")
                return NO
            kind = self.star_expression()
            if self.at("for", "async"):
                self.comprehension()
                self.need(")")
                return NO
            if self.eat(")"):
                if kind == STARRED:
                    self.fail("cannot use a starred expression here")
                return kind
            good = kind != NO
            while self.eat(","):
                if self.at(")"):
                    break
                good &= self.star_expression() != NO
            self.need(")")
            return MANY if good else NO
        if k == "[":
            self.p += 1
            if self.eat("]"):
                return MANY
            good = self.star_expression() != NO
            if self.at("for", "async"):
                self.comprehension()
                self.need("]")
                return NO
            while self.eat(","):
                if self.at("]"):
                    break
                good &= self.star_expression() != NO
            self.need("]")
            return MANY if good else NO
        if k == "{":
            self.p += 1
            self.braces()
            return NO
        self.fail("expected an expression")
        return NO

    def braces(self) -> None:
        if self.eat("}"):
            return
        if self.at("**"):
            mapping = True
            self.p += 1
            self.binary(0)
        else:
            self.star_expression()
            mapping = self.eat(":")
            if mapping:
                self.test()
            if self.at("for", "async"):
                self.comprehension()
                self.need("}")
                return
        while self.eat(","):
            if self.at("}"):
                break
            if mapping:
                if self.eat("**"):
                    self.binary(0)
                else:
                    self.test()
                    self.need(":")
                    self.test()
            else:
                self.star_expression()
        self.need("}")

    RULES = {}
    SIMPLE = {}


Python.RULES = {
    "if": Python.if_, "while": Python.while_, "for": Python.for_, "try": Python.try_, "with": Python.with_,
    "def": Python.def_, "class": Python.class_, "async": Python.async_, "@": Python.decorated,
}
Python.SIMPLE = {
    "pass": Python.pass_, "break": Python.pass_, "continue": Python.pass_, "del": Python.del_, "return": Python.return_,
    "raise": Python.raise_, "global": Python.global_, "nonlocal": Python.global_, "assert": Python.assert_,
    "import": Python.import_, "from": Python.from_, "yield": Python.yield_,
}


def parse(text: str) -> list[tuple[int, str]]:
    """Faults of a module: (offset, what)."""
    if text.startswith("\ufeff"):
        text = text[1:]
    return Python(Lexer(text).run(), text).run()
