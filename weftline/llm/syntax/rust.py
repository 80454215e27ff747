"""Rust source files."""

from __future__ import annotations

import re

from weftline.llm.syntax.base import CLOSERS, EOF, Parser, Tokens, punctuation, words

RESERVED = words(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self "
    "Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro "
    "override priv typeof unsized virtual yield try gen"
) - {"gen", "try"}
ESC = r"\\(?:[nrt0\\'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\})"
WORD = r"[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_\u0080-\U0010ffff]*"
TOKEN = re.compile(
    r"(?P<ws>[ \t\f\v\u0085\u200e\u200f\u2028\u2029]+|//[^\n]*)|(?P<nl>\r?\n|\r)|(?P<com>/\*)|(?P<raw>(?:br|cr|r)(?P<h>#*)\")"
    r"|(?P<str>[bc]?\"(?:[^\"\\]|\\(?:[nrt0\\'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n\s*))*\")"
    r"|(?P<chr>b?'(?:[^'\\\n\r\t]|%s)')|(?P<life>'(?:r#)?%s)(?!')|(?P<id>(?:r#)?%s)"
    r"|(?P<num>0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?"
    r"|[0-9][0-9_]*(?:\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?(?:f32|f64)?|[eE][+-]?[0-9_]+(?:f32|f64)?|\.(?![.A-Za-z_])|(?:[iu](?:8|16|32|64|128|size)|f32|f64))?)"
    r"|(?P<op>%s)"
    % (ESC, WORD, WORD, punctuation(
        "{ } ( ) [ ] ; , . .. ... ..= : :: -> => # ! = == != > < <= >= && || & | ^ % * / + - ? @ $ ~ << += -= *= /= %= ^= &= |= <<="
    ))
)
NESTED = re.compile(r"/\*|\*/")
CLOSED = re.compile(r"[bc]?\"(?:[^\"\\]|\\[\s\S])*\"")


def lex(text: str) -> Tokens:
    t, i, n, nl = Tokens(), 0, len(text), 0
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        i = text.find("\n") if "\n" in text else n
    match, add = TOKEN.match, t.add
    while i < n:
        m = match(text, i)
        if not m:
            c = text[i]
            t.faults.append((i, "unterminated or bad literal" if c in "\"'bc" and '"' in text[i : i + 2] or c == "'" else f"unexpected character {c!r}"))
            if c == '"' or text.startswith(('b"', 'c"'), i):
                closed = CLOSED.match(text, i)
                if not closed:
                    break  # an open string runs to the end
                add("str", i, closed.end(), nl)
                nl, i = 0, closed.end()
                continue
            i += 1
            continue
        kind, s = m.lastgroup, m.group()
        e = m.end()
        if kind == "h":
            kind = "raw"
        if kind == "ws":
            i = e
            continue
        if kind == "nl":
            nl, i = 1, e
            continue
        if kind == "com":
            depth, j = 1, e
            while depth:
                c = NESTED.search(text, j)
                if not c:
                    t.faults.append((i, "unterminated comment"))
                    return t.close(n)
                depth += 1 if c.group() == "/*" else -1
                j = c.end()
            i = j
            continue
        if kind == "raw":
            close = text.find('"' + m["h"], e)
            if close < 0:
                t.faults.append((i, "unterminated raw string"))
                break
            e, kind = close + 1 + len(m["h"]), "str"
        elif kind == "id":
            kind = s if s in RESERVED else "id"
        elif kind == "op":
            kind = s
        elif kind == "num" and e < n and (text[e].isalnum() or text[e] == "_"):
            t.faults.append((i, "bad number"))
        add(kind, i, e, nl)
        nl = 0
        i = e
    return t.close(n)


BINARY = {
    "||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, "+": 10, "-": 10,
    "*": 11, "/": 11, "%": 11,
}
ASSIGN = words("= += -= *= /= %= ^= &= |= <<=")
ITEM = words("use mod fn struct enum impl trait type static extern pub macro_rules union")
BLOCK_LIKE = words("if match while loop for unsafe {")


class Rust(Parser):

    def __init__(self, tokens: Tokens, text: str):
        super().__init__(tokens)
        self.x = text
        self.no_struct = False

    def word(self, i: int = 0) -> str:
        j = self.p + i
        return self.x[self.t.start[j] : self.t.end[j]] if j < len(self.k) and self.k[j] == "id" else ""

    def program(self) -> None:
        while self.at("#") and self.peek() == "!" and self.peek(2) == "[":
            self.p += 2
            self.balanced()
        self.statements(self.item)

    def name(self) -> None:
        self.need("id")

    def attributes(self) -> None:
        while self.at("#"):
            self.p += 1
            self.eat("!")
            if not self.at("["):
                self.fail("expected [")
            self.balanced()

    def visibility(self) -> None:
        if self.eat("pub") and self.at("(") and self.peek() in ("crate", "self", "super", "in"):
            self.balanced()

    def item_here(self) -> bool:
        k = self.k[self.p]
        if k in ("use", "mod", "fn", "struct", "enum", "impl", "trait", "type", "pub"):
            return True
        nxt = self.peek()
        if k == "extern":
            return nxt in ("crate", "str", "{", "fn")
        if k == "static":
            return nxt in ("id", "mut")
        if k == "const":
            return nxt in ("id", "fn", "unsafe", "extern", "async") or (nxt == "mut")
        if k == "unsafe":
            return nxt in ("fn", "impl", "trait", "extern", "mod")
        if k == "async":
            return nxt in ("fn", "unsafe")
        w = self.word()
        if w == "macro_rules":
            return nxt == "!" and self.peek(2) == "id"
        if w == "union":
            return nxt == "id"
        return w in ("auto", "default") and nxt in ("trait", "impl", "fn", "type", "const", "unsafe")

    def item(self) -> None:
        self.attributes()
        self.visibility()
        if self.word() in ("auto", "default", "safe"):
            self.p += 1
        k = self.k[self.p]
        if k == "use":
            self.p += 1
            self.use_tree()
            self.need(";")
        elif k == "mod" or (k == "unsafe" and self.peek() == "mod"):
            self.eat("unsafe")
            self.p += 1
            self.name()
            if not self.eat(";"):
                self.need("{")
                self.statements(self.item, "}")
                self.need("}")
        elif k == "extern" and self.peek() == "crate":
            self.p += 2
            if not self.eat("self"):
                self.name()
            if self.eat("as"):
                self.name()
            self.need(";")
        elif k in ("extern", "unsafe") and self.block_of_externs():
            pass
        elif k in ("fn", "async", "unsafe", "extern") and not (k == "unsafe" and self.peek() in ("impl", "trait")):
            self.function()
        elif k == "const" and self.peek() in ("fn", "unsafe", "extern", "async"):
            self.function()
        elif k == "struct" or (self.word() == "union" and self.peek() == "id"):
            self.struct()
        elif k == "enum":
            self.enum()
        elif k in ("impl", "unsafe") and (k == "impl" or self.peek() == "impl"):
            self.impl()
        elif k in ("trait", "unsafe"):
            self.trait()
        elif k == "type":
            self.alias()
        elif k in ("const", "static"):
            self.p += 1
            self.eat("mut")
            self.name()
            self.generics()
            self.need(":")
            self.type()
            if self.eat("="):
                self.expression()
            self.need(";")
        elif self.word() == "macro_rules" and self.peek() == "!":
            self.p += 2
            self.name()
            self.macro_body()
        elif k in ("id", "crate", "self", "super", "::"):
            self.simple_path()
            self.need("!")
            self.macro_body()
        else:
            self.fail("expected an item")

    def macro_body(self) -> None:
        brace = self.at("{")
        if not self.at("(", "[", "{"):
            self.fail("expected a macro body")
        self.balanced()
        if not brace:
            self.need(";")

    def block_of_externs(self) -> bool:
        p = self.p
        self.eat("unsafe")
        if self.eat("extern"):
            self.eat("str")
            if self.eat("{"):
                self.statements(self.item, "}")
                self.need("}")
                return True
        self.p = p
        return False

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                self.listed(self.use_tree, "}")
                return
            if not (self.at("id", "crate", "self", "super", "Self")):
                self.fail("expected a path")
            self.p += 1
            if not self.eat("::"):
                break
        if self.eat("as"):
            self.name()

    def simple_path(self) -> None:
        self.eat("::")
        while True:
            if not self.at("id", "crate", "self", "super", "Self"):
                self.fail("expected a path")
            self.p += 1
            if not self.eat("::"):
                return

    def function(self) -> None:
        while self.at("const", "async", "unsafe", "extern"):
            if self.eat("extern"):
                self.eat("str")
            else:
                self.p += 1
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        if self.at("&") and (self.peek() == "self" or self.peek(2) == "self" or self.peek(3) == "self") or self.at("self") or (self.at("mut") and self.peek() == "self"):
            p = self.p
            if self.eat("&"):
                self.eat("life")
            self.eat("mut")
            if self.eat("self"):
                if self.eat(":"):
                    self.type()
                return
            self.p = p
        if self.eat("..."):
            return
        self.pattern()
        self.need(":")
        if not self.eat("..."):
            self.type()

    def generics(self) -> None:
        if self.eat("<"):

            def one():
                self.attributes()
                if self.eat("life"):
                    if self.eat(":"):
                        self.bounds()
                    return
                if self.eat("const"):
                    self.name()
                    self.need(":")
                    self.type()
                    if self.eat("="):
                        if self.at("{"):
                            self.block()
                        else:
                            self.eat("-")
                            self.p += 1
                    return
                self.name()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()

            self.listed(one, ">")

    def bounds(self) -> None:
        while self.at("life", "?", "id", "(", "for", "::", "crate", "self", "super", "Self", "~", "const", "use", "async"):
            if self.eat("life"):
                pass
            elif self.eat("("):
                self.bounds()
                self.need(")")
            elif self.eat("use"):
                self.generics()
            else:
                while self.at("?", "~", "const", "async"):
                    self.p += 1
                self.for_lifetimes()
                self.type_path()
            if not self.eat("+"):
                return

    def for_lifetimes(self) -> None:
        if self.eat("for"):
            self.generics()

    def where(self) -> None:
        if self.eat("where"):
            while not self.at("{", ";", "="):
                if self.eat("life"):
                    pass
                else:
                    self.for_lifetimes()
                    self.type()
                self.need(":")
                self.bounds()
                if not self.eat(","):
                    return

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def struct(self) -> None:
        self.p += 1
        self.name()
        self.generics()
        self.where()
        if self.eat("{"):
            self.listed(self.field, "}")
        elif self.eat("("):
            self.listed(self.tuple_field, ")")
            self.where()
            self.need(";")
        else:
            self.need(";")

    def enum(self) -> None:
        self.p += 1
        self.name()
        self.generics()
        self.where()
        self.need("{")

        def variant():
            self.attributes()
            self.visibility()
            self.name()
            if self.eat("{"):
                self.listed(self.field, "}")
            elif self.eat("("):
                self.listed(self.tuple_field, ")")
            if self.eat("="):
                self.expression()

        self.listed(variant, "}")

    def impl(self) -> None:
        self.eat("unsafe")
        self.need("impl")
        if self.at("<") and self.peek() in ("life", "id", "const", ">", "#"):
            self.generics()
        self.eat("const")
        self.eat("!")
        self.type()
        if self.eat("for"):
            self.type()
        self.where()
        self.members()

    def members(self) -> None:
        self.need("{")
        while self.at("#") and self.peek() == "!":
            self.p += 2
            self.balanced()
        self.statements(self.member, "}")
        self.need("}")

    def member(self) -> None:
        p = self.p
        self.attributes()
        self.visibility()
        if self.word() == "default":
            self.p += 1
        if self.at("type"):
            self.alias()
        elif self.at("const", "fn", "async", "unsafe", "extern"):
            self.item()
        elif self.at("id", "crate", "self", "super", "::") and p == self.p:
            self.item()
        else:
            self.fail("expected a member")

    def alias(self) -> None:
        self.need("type")
        self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        if self.eat("="):
            self.type()
        self.where()
        self.need(";")

    def trait(self) -> None:
        self.eat("unsafe")
        self.need("trait")
        self.name()
        self.generics()
        if self.eat("="):
            self.bounds()
            self.where()
            self.need(";")
            return
        if self.eat(":"):
            self.bounds()
        self.where()
        self.members()

    # types
    def type(self) -> None:
        k = self.k[self.p]
        if k in ("&", "&&"):
            self.p += 1
            self.eat("life")
            self.eat("mut")
            self.type_no_bounds()
        elif k == "dyn" or k == "impl":
            self.p += 1
            self.bounds()
        else:
            self.type_no_bounds()
            while self.at("+") and self.peek() in ("life", "id", "?"):
                self.p += 1
                self.bounds()

    def type_no_bounds(self) -> None:
        k = self.k[self.p]
        if k in ("&", "&&"):
            self.p += 1
            self.eat("life")
            self.eat("mut")
            self.type_no_bounds()
        elif k in ("dyn", "impl"):
            self.p += 1
            self.bounds()
        elif k == "*":
            self.p += 1
            if not (self.eat("const") or self.eat("mut")):
                self.fail("expected const or mut")
            self.type_no_bounds()
        elif k == "!":
            self.p += 1
        elif k == "(":
            self.p += 1
            self.listed(self.type, ")")
        elif k == "[":
            self.p += 1
            self.type()
            if self.eat(";"):
                self.expression()
            self.need("]")
        elif k in ("fn", "unsafe", "extern", "for"):
            self.for_lifetimes()
            if self.at("fn", "unsafe", "extern"):
                self.eat("unsafe")
                if self.eat("extern"):
                    self.eat("str")
                self.need("fn")
                self.need("(")

                def one():
                    self.attributes()
                    if self.eat("..."):
                        return
                    if self.at("id") and self.peek() == ":":
                        self.p += 2
                    self.type()

                self.listed(one, ")")
                if self.eat("->"):
                    self.type_no_bounds()
            else:
                self.type_path()
        elif k == "id" and self.word() == "_":
            self.p += 1
        elif k in ("id", "crate", "self", "super", "Self", "::", "<"):
            self.type_path()
            if self.at("!") and self.peek() in ("(", "[", "{"):
                self.p += 1
                self.balanced()
        else:
            self.fail("expected a type")

    def type_path(self) -> None:
        if self.eat("<"):
            self.type()
            if self.eat("as"):
                self.type_path()
            self.need(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if not self.at("id", "crate", "self", "super", "Self"):
                self.fail("expected a path")
            self.p += 1
            if self.at("<") or (self.at("::") and self.peek() == "<"):
                self.eat("::")
                self.generic_arguments()
            elif self.at("(") and self.word(-1)[:2] == "Fn":
                self.p += 1
                self.listed(self.type, ")")
                if self.eat("->"):
                    self.type_no_bounds()
            if self.at("::") and self.peek() != "{" and self.peek() != "*":
                self.p += 1
                continue
            return

    def generic_arguments(self) -> None:
        self.need("<")

        def one():
            if self.eat("life"):
                return
            if self.at("num", "str", "chr", "true", "false", "-"):
                self.eat("-")
                self.p += 1
                return
            if self.at("{"):
                self.block()
                return
            if self.at("id") and self.peek() in ("=", ":"):
                self.p += 1
                if self.eat(":"):
                    self.bounds()
                else:
                    self.p += 1
                    self.type()
                return
            self.type()
            if self.eat("="):
                self.type()

        self.listed(one, ">")

    # patterns
    def pattern(self) -> None:
        self.eat("|")
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        k = self.k[self.p]
        if k in ("&", "&&"):
            self.p += 1
            self.eat("mut")
            self.pattern_one()
        elif k in ("ref", "mut"):
            self.eat("ref")
            self.eat("mut")
            self.name()
            if self.eat("@"):
                self.pattern_one()
        elif k == "(":
            self.p += 1
            self.listed(self.pattern, ")")
        elif k == "[":
            self.p += 1
            self.listed(self.pattern, "]")
        elif k in ("..", "..=", "..."):
            self.p += 1
            if self.at("num", "chr", "str", "-", "id"):
                self.range_end()
        elif k in ("num", "str", "chr", "true", "false", "-"):
            self.range_end()
            if self.at("..=", "...", ".."):
                self.p += 1
                if self.at("num", "chr", "-", "id", "str"):
                    self.range_end()
        elif k in ("id", "crate", "self", "super", "Self", "::", "<"):
            if k == "id" and self.peek() == "@":
                self.p += 2
                self.pattern_one()
                return
            self.type_path()
            if self.eat("!"):
                self.balanced()
            elif self.eat("("):
                self.listed(self.pattern, ")")
            elif self.at("{"):
                self.p += 1

                def one():
                    self.attributes()
                    if self.eat(".."):
                        return
                    if self.at("id", "num") and self.peek() == ":":
                        self.p += 2
                        self.pattern()
                        return
                    self.eat("ref")
                    self.eat("mut")
                    self.name()

                self.listed(one, "}")
            elif self.at("..=", "...", ".."):
                self.p += 1
                if self.at("num", "chr", "-", "id"):
                    self.range_end()
        else:
            self.fail("expected a pattern")

    def range_end(self) -> None:
        self.eat("-")
        if self.at("id", "crate", "self", "Self", "super"):
            self.type_path()
        elif self.at("num", "chr", "str", "true", "false"):
            self.p += 1
        else:
            self.fail("expected a literal")

    # statements
    def block(self) -> None:
        held, self.no_struct = self.no_struct, False
        self.need("{")
        while self.at("#") and self.peek() == "!":
            self.p += 2
            self.balanced()
        self.statements(self.statement, "}")
        self.need("}")
        self.no_struct = held

    def statement(self) -> None:
        if self.eat(";"):
            return
        self.attributes()
        if self.item_here():
            self.item()
            return
        if self.eat("let"):
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
                if self.eat("else"):
                    self.block()
            self.need(";")
            return
        k = self.k[self.p]
        block_like = k in BLOCK_LIKE or (k == "life" and self.peek() == ":") or (k in ("async", "const") and self.peek() in ("{", "move"))
        if block_like:
            self.block_expression()
            if self.at(".", "?"):
                self.postfix_rest()
                self.binary_rest(0)
                self.assign_rest()
                if not self.eat(";") and not self.at("}"):
                    self.fail("expected ;")
            else:
                self.eat(";")
            return
        macro_brace = self.macro_with_brace()
        self.expression()
        if macro_brace and self.k[self.p - 1] == "}":
            self.eat(";")
            return
        if not self.eat(";") and not self.at("}"):
            self.fail("expected ;")

    def macro_with_brace(self) -> bool:
        i = 0
        while self.peek(i) in ("id", "::", "crate", "self", "super"):
            i += 1
        return i > 0 and self.peek(i) == "!" and self.peek(i + 1) == "{"

    def block_expression(self) -> None:
        if self.eat("life"):
            self.need(":")
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif k == "unsafe":
            self.p += 1
            self.block()
        elif k == "const":
            self.p += 1
            self.block()
        elif k == "async":
            self.p += 1
            self.eat("move")
            self.block()
        elif k == "loop":
            self.p += 1
            self.block()
        elif k == "while":
            self.p += 1
            self.condition()
            self.block()
        elif k == "for":
            self.p += 1
            self.pattern()
            self.need("in")
            self.head()
            self.block()
        elif k == "if":
            self.p += 1
            self.condition()
            self.block()
            if self.eat("else"):
                if self.at("if"):
                    self.block_expression()
                else:
                    self.block()
        elif k == "match":
            self.p += 1
            self.head()
            self.need("{")
            while self.at("#") and self.peek() == "!":
                self.p += 2
                self.balanced()
            held, self.no_struct = self.no_struct, False
            while not self.eat("}"):
                self.attributes()
                self.pattern()
                if self.eat("if"):
                    self.condition()
                self.need("=>")
                braces = self.k[self.p] in BLOCK_LIKE
                self.expression()
                if not self.eat(",") and not self.at("}") and not (braces and self.k[self.p - 1] == "}"):
                    self.fail("expected ,")
            self.no_struct = held
        else:
            self.fail("expected a block")

    def head(self) -> None:
        held, self.no_struct = self.no_struct, True
        self.expression()
        self.no_struct = held

    def condition(self) -> None:
        held, self.no_struct = self.no_struct, True
        while True:
            if self.eat("let"):
                self.pattern()
                self.need("=")
                self.binary(5)
            else:
                self.expression(least=5 if self.chain() else 0)
            if not self.eat("&&"):
                break
        if self.eat("||"):
            self.expression()
        self.no_struct = held

    def chain(self) -> bool:
        """A `let` follows before the block: conditions are read one by one."""
        i = self.p
        while self.k[i] not in ("{", EOF, ";"):
            if self.k[i] == "let":
                return True
            i += 1
        return False

    # expressions
    def free(self, rule) -> None:
        held, self.no_struct = self.no_struct, False
        rule()
        self.no_struct = held

    def attempt(self, rule) -> bool:
        held = self.no_struct
        done = super().attempt(rule)
        self.no_struct = held
        return done

    def arguments(self) -> None:
        self.listed(self.argument, ")")

    def expression(self, least: int = 0) -> None:
        if self.at("..", "..="):
            self.p += 1
            if self.starts_expression():
                self.binary(2)
            return
        self.binary(least)
        self.assign_rest()

    def starts_expression(self) -> bool:
        k = self.k[self.p]
        return k not in CLOSERS and k not in (";", ",", "=>", EOF, "else") and not (k == "{" and self.no_struct)

    def assign_rest(self) -> None:
        k = self.k[self.p]
        if k == ">" and self.k[self.p + 1] == ">=" and self.adjacent(self.p + 1):
            self.p += 1
            k = "="
        if k in ASSIGN:
            self.p += 1
            self.expression()

    def binary(self, least: int) -> None:
        self.unary()
        self.binary_rest(least)

    def binary_rest(self, least: int) -> None:
        while True:
            k = self.k[self.p]
            if k == "as":
                self.p += 1
                self.type_no_bounds()
                continue
            if k in ("..", "..="):
                if least > 2:
                    return
                self.p += 1
                if self.starts_expression():
                    self.binary(3)
                if self.at("..", "..="):
                    self.fail("ranges cannot be chained")
                continue
            level = BINARY.get(k, 0)
            step = 1
            if k == ">":
                if self.k[self.p + 1] == ">" and self.adjacent(self.p + 1):
                    step, level = 2, 9
                elif self.k[self.p + 1] == ">=" and self.adjacent(self.p + 1):
                    return
            if not level or level <= least:
                return
            self.p += step
            self.binary(level)
            if level == 5 and least <= 5 and BINARY.get(self.k[self.p]) == 5 and not (self.k[self.p] == ">" and self.k[self.p + 1] in (">", ">=") and self.adjacent(self.p + 1)):
                self.fail("comparison operators cannot be chained")

    def unary(self) -> None:
        k = self.k[self.p]
        if k in ("-", "!", "*"):
            self.p += 1
            self.unary()
            return
        if k in ("&", "&&"):
            self.p += 1
            if self.word() == "raw" and self.peek() in ("const", "mut"):
                self.p += 1
                self.p += 1
            self.eat("mut")
            self.unary()
            return
        self.primary()
        self.postfix_rest()

    def postfix_rest(self) -> None:
        while True:
            k = self.k[self.p]
            if k == "?":
                self.p += 1
            elif k == ".":
                self.p += 1
                if self.eat("await"):
                    continue
                if self.at("num"):
                    if self.x[self.t.end[self.p] - 1] == ".":
                        self.fail("expected a field")
                    self.p += 1
                    continue
                self.name()
                if self.at("::"):
                    self.p += 1
                    self.generic_arguments()
                if self.at("("):
                    self.call()
            elif k == "(":
                self.call()
            elif k == "[":
                self.p += 1
                self.free(self.expression)
                self.need("]")
            else:
                return

    def call(self) -> None:
        self.need("(")
        self.free(self.arguments)

    def argument(self) -> None:
        self.attributes()
        self.expression()

    def primary(self) -> None:
        k = self.k[self.p]
        if k in ("num", "str", "chr", "true", "false"):
            self.p += 1
        elif k in ("id", "crate", "self", "super", "Self", "::", "<"):
            self.path_expression()
        elif k == "(":
            self.p += 1
            self.free(self.arguments)
        elif k == "[":
            self.p += 1
            held, self.no_struct = self.no_struct, False
            if not self.eat("]"):
                self.argument()
                if self.eat(";"):
                    self.expression()
                    self.need("]")
                elif not self.eat("]"):
                    self.need(",")
                    self.listed(self.argument, "]")
            self.no_struct = held
        elif k in ("|", "||", "move", "static") or (k == "async" and self.peek() in ("move", "|", "||") and self.closure_after_async()):
            self.closure()
        elif k in BLOCK_LIKE or k in ("life", "async", "const"):
            self.block_expression()
        elif k in ("return", "break", "become", "yield"):
            self.p += 1
            if k == "break":
                self.eat("life")
            if self.starts_expression():
                self.expression()
        elif k == "continue":
            self.p += 1
            self.eat("life")
        elif k == "let":
            self.p += 1
            self.pattern()
            self.need("=")
            self.binary(5)
        else:
            self.fail("expected an expression")

    def closure_after_async(self) -> bool:
        return self.peek() in ("|", "||") or self.peek(2) in ("|", "||")

    def closure(self) -> None:
        self.eat("static")
        self.eat("async")
        self.eat("move")
        if not self.eat("||"):
            self.need("|")

            def one():
                self.attributes()
                self.pattern_one()
                if self.eat(":"):
                    self.type()

            self.listed(one, "|")
        if self.eat("->"):
            self.type_no_bounds()
            self.block()
        else:
            self.expression()

    def path_expression(self) -> None:
        if self.eat("<"):
            self.type()
            if self.eat("as"):
                self.type_path()
            self.need(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if not self.at("id", "crate", "self", "super", "Self"):
                self.fail("expected a path")
            self.p += 1
            if not self.at("::"):
                break
            self.p += 1
            if self.at("<"):
                self.generic_arguments()
                if not self.eat("::"):
                    break
        if self.at("!") and self.peek() in ("(", "[", "{"):
            self.p += 1
            self.balanced()
        elif self.at("{") and not self.no_struct and self.struct_body():
            pass

    def struct_body(self) -> bool:
        """A struct literal; a block cannot follow a path here."""
        self.need("{")

        def one():
            self.attributes()
            if self.eat(".."):
                if not self.at("}"):
                    self.expression()
                if self.at(","):
                    self.fail("no comma after the base")
                return
            if self.eat("num"):
                self.need(":")
                self.expression()
                return
            self.name()
            if self.eat(":"):
                self.expression()

        self.listed(one, "}")
        return True


def parse(text: str) -> list[tuple[int, str]]:
    """Faults of a crate file: (offset, what)."""
    if text.startswith("\ufeff"):
        text = text[1:]
    return Rust(lex(text), text).run()
