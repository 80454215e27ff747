"""Java source files."""

from __future__ import annotations

import re

from weftline.llm.syntax.base import Parser, Tokens, punctuation, words

RESERVED = words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
)
PRIMITIVE = words("boolean byte char short int long float double")
NAME = r"[A-Za-z_$\u00a2-\uffff\U00010000-\U0010ffff][A-Za-z0-9_$\u00a2-\uffff\U00010000-\U0010ffff]*"
ESC = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
TOKEN = re.compile(
    r"(?P<ws>[ \t\f]+|//[^\n\r]*)|(?P<nl>\r\n?|\n)|(?P<com>/\*(?:[^*]|\*(?!/))*\*/)|(?P<id>%s)"
    r"|(?P<num>0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?"
    r"|(?:[0-9](?:[0-9_]*[0-9])?)(?:\.(?:[0-9](?:[0-9_]*[0-9])?)?(?:[eE][+-]?[0-9]+)?[fFdD]?|[eE][+-]?[0-9]+[fFdD]?|[fFdDlL])?|\.[0-9]+(?:[eE][+-]?[0-9]+)?[fFdD]?)"
    r"|(?P<text>\"\"\"[ \t\f]*(?:\r\n?|\n)(?:[^\\\"]|\\(?:[\s\S])|\"(?!\"\"))*\"\"\")"
    r"|(?P<str>\"(?:[^\"\\\n\r]|%s)*\")|(?P<chr>'(?:[^'\\\n\r]|%s)')|(?P<op>%s)"
    % (NAME, ESC, ESC, punctuation(
        "{ } ( ) [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= >= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<="
    ))
)


def lex(text: str) -> Tokens:
    t, i, n, nl = Tokens(), 0, len(text), 0
    match, add = TOKEN.match, t.add
    while i < n:
        m = match(text, i)
        if not m:
            c = text[i]
            if c == "\x1a" and i == n - 1:
                break
            if text.startswith("/*", i):
                t.faults.append((i, "unterminated comment"))
                break
            if text.startswith('"""', i):
                t.faults.append((i, "bad text block"))
                close = text.find('"""', i + 3)
                if close < 0:
                    break
                add("str", i, close + 3, nl)
                nl, i = 0, close + 3
                continue
            t.faults.append((i, f"unterminated or bad literal {c}" if c in "\"'" else f"unexpected character {c!r}"))
            line = text.find("\n", i)
            i = (n if line < 0 else line) if c in "\"'" else i + 1
            continue
        kind, s = m.lastgroup, m.group()
        e = m.end()
        if kind == "ws":
            pass
        elif kind == "nl":
            nl = 1
        elif kind == "com":
            nl |= "\n" in s
        else:
            if kind == "id":
                kind = s if s in RESERVED else "id"
            elif kind == "op":
                kind = s
            elif kind == "num":
                if e < n and (text[e].isalnum() or text[e] == "_"):
                    t.faults.append((i, "bad number"))
                elif s.replace("_", "").isdigit():
                    digits = s.replace("_", "")
                    if digits[0] == "0" and len(digits) > 1 and ("8" in digits or "9" in digits):
                        t.faults.append((i, "bad number"))
                    elif digits[0] != "0" and (len(digits) > 10 or int(digits) > 2147483648):
                        t.faults.append((i, "number too large"))
            elif kind == "text":
                kind = "str"
            add(kind, i, e, nl)
            nl = 0
        i = e
    return t.close(n)


BINARY = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8,
    "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
ASSIGN = words("= += -= *= /= %= &= |= ^= <<=")
MODIFIER = words("public protected private static abstract final native synchronized transient volatile strictfp default")
VALUE, TARGET, EFFECT = 0, 1, 2


class Java(Parser):

    def __init__(self, tokens: Tokens, text: str):
        super().__init__(tokens)
        self.x = text
        self.types: list[str] = []
        self.seen = 0

    def attempt(self, rule) -> bool:
        held = len(self.types)
        done = super().attempt(rule)
        del self.types[held:]
        return done

    def word(self, i: int = 0) -> str:
        j = self.p + i
        return self.x[self.t.start[j] : self.t.end[j]] if j < len(self.k) and self.k[j] == "id" else ""

    def program(self) -> None:
        self.statements(self.top)

    def top(self) -> None:
        if self.eat(";"):
            return
        p = self.p
        self.modifiers()
        if self.eat("package"):
            if self.seen:
                self.fail("a package declaration comes first")
            self.seen = 1
            self.qualified()
            self.need(";")
            return
        if p == self.p and self.at("import"):
            if self.seen == 2:
                self.fail("imports come before types")
            self.seen = 1
            self.p += 1
            self.eat("static")
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            self.need(";")
            return
        if self.word() in ("module", "open") and self.peek() == "id":
            self.p += 1
            self.eat("id")
            while self.eat("."):
                self.name()
            self.balanced()
            return
        self.p = p
        self.seen = 2
        self.type_declaration()

    def qualified(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def name(self) -> None:
        self.need("id")

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek() != "interface":
                self.annotation()
            elif self.k[self.p] in MODIFIER and not (self.at("default") and self.peek() in (":", "->")):
                if self.at("synchronized") and self.peek() == "(":
                    return
                self.p += 1
            elif self.word() == "sealed" and (self.peek() in MODIFIER or self.peek() in ("class", "interface", "@")):
                self.p += 1
            elif self.word() == "non" and self.peek() == "-" and self.word(2) == "sealed":
                self.p += 3
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.eat("("):
            if self.eat(")"):
                return
            if self.at("id") and self.peek() == "=":

                def pair():
                    self.name()
                    self.need("=")
                    self.element_value()

                self.listed(pair, ")", trailing=False)
            else:
                self.element_value()
                self.need(")")

    def element_value(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.eat("{"):
            self.listed(self.element_value, "}")
        else:
            self.ternary()

    def class_ahead(self) -> bool:
        return self.at("class", "interface", "enum") or (self.at("@") and self.peek() == "interface") or (
            self.word() == "record" and self.peek() == "id" and self.peek(2) in ("(", "<")
        )

    def type_declaration(self) -> None:
        self.modifiers()
        if self.eat("class"):
            name = self.word()
            self.name()
            self.type_parameters()
            if self.eat("extends"):
                self.type()
            self.type_list("implements")
            self.permits()
            self.class_body(name)
        elif self.at("interface") or self.at("@"):
            if self.eat("@"):
                pass
            self.need("interface")
            self.name()
            self.type_parameters()
            self.type_list("extends")
            self.permits()
            self.class_body()
        elif self.eat("enum"):
            name = self.word()
            self.name()
            self.type_list("implements")
            self.enum_body(name)
        elif self.word() == "record":
            self.p += 1
            name = self.word()
            self.name()
            self.type_parameters()
            self.need("(")
            self.listed(self.parameter, ")", trailing=False)
            self.type_list("implements")
            self.class_body(name)
        else:
            self.fail("expected a type declaration")

    def permits(self) -> None:
        if self.word() == "permits":
            self.p += 1
            self.type()
            while self.eat(","):
                self.type()

    def type_list(self, word: str) -> None:
        if self.eat(word):
            self.type()
            while self.eat(","):
                self.type()

    def enum_body(self, name: str) -> None:
        self.need("{")
        while not self.at("}", ";"):
            while self.at("@"):
                self.annotation()
            self.name()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.class_body()
            if not self.eat(","):
                break
        if self.eat(";"):
            self.members(name)
        self.need("}")

    def class_body(self, name: str = "") -> None:
        """Members of a type; without a name it has no constructors."""
        self.need("{")
        self.members(name)
        self.need("}")

    def members(self, name: str) -> None:
        self.types.append(name)
        self.statements(self.member, "}")
        self.types.pop()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.at("{") or (self.at("static") and self.peek() == "{"):
            self.eat("static")
            self.block()
            return
        p = self.p
        self.modifiers()
        if self.class_ahead():
            self.p = p
            self.type_declaration()
            return
        self.type_parameters()
        while self.at("@"):
            self.annotation()
        if self.at("id") and self.peek() in ("(", "{"):  # constructor
            if self.word() != self.types[-1]:
                self.fail("a method without a return type")
            self.p += 1
            if self.at("("):
                self.method_rest()
            else:
                self.block()
            return
        if not self.eat("void"):
            self.type()
        self.name()
        if self.at("("):
            self.method_rest()
            return
        self.declarators()
        self.need(";")

    def method_rest(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)
        self.dims()
        self.type_list("throws")
        if self.eat("default"):
            self.element_value()
        if not self.eat(";"):
            self.block()

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        while self.at("@"):
            self.annotation()
        self.eat("...")
        if self.eat("this"):
            return
        self.name()
        if self.eat("."):
            self.need("this")
        self.dims()

    def dims(self) -> None:
        while self.at("[") and self.peek() == "]":
            self.p += 2

    def declarators(self) -> None:
        """After the first name: dims, value, and more names."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.eat("{"):
            self.listed(self.initializer, "}")
        else:
            self.expression()

    # types
    def type_parameters(self) -> None:
        if self.eat("<"):

            def one():
                while self.at("@"):
                    self.annotation()
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()

            self.listed(one, ">", trailing=False)

    def type(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.k[self.p] in PRIMITIVE:
            self.p += 1
        else:
            self.class_type()
        while self.at("@") and self.peek() == "id":
            self.annotation()
        self.dims()

    def class_type(self) -> None:
        self.name()
        self.type_arguments()
        while self.at(".") and self.peek() in ("id", "@"):
            self.p += 1
            while self.at("@"):
                self.annotation()
            self.name()
            self.type_arguments()

    def type_arguments(self) -> None:
        if self.eat("<"):

            def one():
                while self.at("@"):
                    self.annotation()
                if self.eat("?"):
                    if self.eat("extends") or self.eat("super"):
                        self.type()
                else:
                    self.type()

            self.listed(one, ">", trailing=False)

    # statements
    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.need("}")

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if not self.at("=", ";", ",", ":", "["):
            self.fail("no declaration")

    def embedded(self) -> None:
        """A statement where a declaration may not stand."""
        k = self.k[self.p]
        typed = k in ("id", "@", "final") or k in PRIMITIVE
        if k in ("class", "interface", "enum", "abstract", "static", "final", "@") or self.class_ahead() or (typed and self.peek() != ":" and self.declares()):
            self.fail("a declaration may not stand here")
        self.statement()

    def declares(self) -> bool:
        """A local variable begins here."""
        p = self.p
        done = self.attempt(self.local) and self.at("=", ";", ",", ":", "[")
        self.p = p
        return done

    def statement(self) -> None:
        k = self.k[self.p]
        if k == "{":
            self.block()
        elif self.eat(";"):
            pass
        elif k == "if":
            self.p += 1
            self.condition()
            self.embedded()
            if self.eat("else"):
                self.embedded()
        elif k == "while":
            self.p += 1
            self.condition()
            self.embedded()
        elif k == "do":
            self.p += 1
            self.embedded()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == "for":
            self.for_()
        elif k == "return":
            self.p += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif k == "throw":
            self.p += 1
            self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.p += 1
            self.eat("id")
            self.need(";")
        elif k == "try":
            self.try_()
        elif k == "switch":
            self.p += 1
            self.switch_rest()
        elif k == "synchronized" and self.peek() == "(":
            self.p += 1
            self.condition()
            self.block()
        elif k == "assert":
            self.p += 1
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif k == "id" and self.peek() == ":":
            self.p += 2
            self.statement()
        elif k == "id" and self.word() == "yield" and self.peek() not in ("=", ".", "(", "++", "--", "["):
            self.p += 1
            self.expression()
            self.need(";")
        elif k in ("class", "interface", "enum", "abstract", "static") or self.class_ahead():
            self.type_declaration()
        elif k in ("final", "@"):
            p = self.p
            self.modifiers()
            if self.class_ahead():
                self.p = p
                self.type_declaration()
                return
            self.p = p
            self.local()
            self.declarators()
            self.need(";")
        elif (k == "id" or k in PRIMITIVE) and self.attempt(self.local):
            self.declarators()
            self.need(";")
        else:
            if self.expression() != EFFECT:
                self.fail("not a statement")
            self.need(";")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.p += 1
        self.need("(")
        if not self.at(";"):
            if self.attempt(self.local):
                if self.eat(":"):
                    self.expression()
                    self.need(")")
                    self.embedded()
                    return
                self.declarators()
            else:
                self.expression()
                while self.eat(","):
                    self.expression()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.eat(","):
                self.expression()
        self.need(")")
        self.embedded()

    def try_(self) -> None:
        self.p += 1
        resources = False
        if self.eat("("):
            resources = True
            while not self.eat(")"):
                if self.attempt(self.local):
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.at(")"):
                    self.need(";")
        self.block()
        handled = resources
        while self.eat("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("try without catch")

    def switch_rest(self) -> None:
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("default"):
                pass
            else:
                self.need("case")
                while True:
                    if self.eat("default"):
                        pass
                    elif not self.attempt(self.case_pattern):
                        self.ternary()
                    if not self.eat(","):
                        break
                if self.word() == "when":
                    self.p += 1
                    self.expression()
            if self.eat("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                self.statements(self.statement, "case", "default", "}")

    def case_pattern(self) -> None:
        self.pattern()
        if not self.at("->", ":", ",") and self.word() != "when":
            self.fail("no pattern")

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.eat("("):
            self.listed(self.pattern, ")", trailing=False)
            self.eat("id")
        else:
            self.name()

    # expressions
    def expression(self) -> int:
        if self.lambda_here():
            self.lambda_()
            return VALUE
        kind = self.ternary()
        k = self.k[self.p]
        shift = k == ">" and self.shift_assign()
        if k in ASSIGN or shift:
            if kind != TARGET:
                self.fail("cannot assign")
            self.p += 1
            self.expression()
            return EFFECT
        return kind

    def shift_assign(self) -> bool:
        p = self.p
        while self.k[p] == ">" and self.k[p + 1] in (">", ">=") and self.adjacent(p + 1):
            p += 1
        if self.k[p] == ">=" and p > self.p:
            self.p = p
            return True
        return False

    def lambda_here(self) -> bool:
        if self.at("id"):
            return self.peek() == "->"
        return self.at("(") and self.k[self.closing(self.p) + 1] == "->"

    def lambda_(self) -> None:
        if not self.eat("id"):
            self.need("(")

            def one():
                if self.at("id") and self.peek() in (",", ")"):
                    self.p += 1
                else:
                    self.parameter()

            self.listed(one, ")", trailing=False)
        self.need("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def ternary(self) -> int:
        kind = self.binary(0)
        if self.eat("?"):
            self.expression_no_assign()
            self.need(":")
            self.expression_no_assign()
            return VALUE
        return kind

    def expression_no_assign(self) -> None:
        if self.lambda_here():
            self.lambda_()
        else:
            self.expression()

    def binary(self, least: int) -> int:
        kind = self.unary()
        while True:
            k = self.k[self.p]
            level = BINARY.get(k, 0)
            if not level:
                return kind
            step = 1
            if k == ">":
                while self.k[self.p + step] == ">" and self.adjacent(self.p + step) and step < 3:
                    step += 1
                if self.k[self.p + step] == ">=" and self.adjacent(self.p + step):
                    return kind
                level = 7 if step == 1 else 8
            if level <= least:
                return kind
            self.p += step
            if k == "instanceof":
                if not self.attempt(self.pattern):
                    self.eat("final")
                    self.type()
            else:
                self.binary(level)
            kind = VALUE

    def unary(self) -> int:
        k = self.k[self.p]
        if k in ("++", "--"):
            self.p += 1
            if self.unary() != TARGET:
                self.fail("cannot assign")
            return EFFECT
        if k in ("+", "-", "!", "~"):
            self.p += 1
            self.unary()
            return VALUE
        if k == "(" and self.attempt(self.cast):
            return VALUE
        kind = self.postfix()
        while self.at("++", "--"):
            if kind != TARGET:
                self.fail("cannot assign")
            self.p += 1
            kind = EFFECT
        return kind

    def cast(self) -> None:
        self.need("(")
        plain = self.k[self.p] in PRIMITIVE
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")
        if self.lambda_here():
            self.lambda_()
            return
        if not plain and not (self.at("id", "str", "chr", "num", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or self.k[self.p] in PRIMITIVE):
            self.fail("no cast")
        self.unary()

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.expression, ")", trailing=False)

    def postfix(self) -> int:
        kind = self.primary()
        while True:
            if self.at("."):
                self.p += 1
                if self.at("<"):
                    self.type_arguments()
                if self.eat("new"):
                    self.creator()
                    kind = EFFECT
                elif self.at("class", "this"):
                    self.p += 1
                    kind = VALUE
                elif self.eat("super"):
                    kind = VALUE
                    if self.at("("):
                        self.arguments()
                        kind = EFFECT
                else:
                    self.name()
                    kind = TARGET
                    if self.at("("):
                        self.arguments()
                        kind = EFFECT
            elif self.at("["):
                self.p += 1
                if self.eat("]"):  # a type: int[]::new, String[].class
                    self.dims()
                    if not self.at("::", "."):
                        self.fail("unexpected")
                    kind = VALUE
                    continue
                self.expression()
                self.need("]")
                kind = TARGET
            elif self.at("::"):
                self.p += 1
                if self.at("<"):
                    self.type_arguments()
                if not self.eat("new"):
                    self.name()
                kind = VALUE
            else:
                return kind

    def generic_reference(self) -> None:
        self.class_type()
        self.dims()
        if not self.at("::"):
            self.fail("no reference")

    def primary(self) -> int:
        k = self.k[self.p]
        if k == "id":
            if self.peek() == "<" and self.attempt(self.generic_reference):
                return VALUE
            self.p += 1
            if self.at("("):
                self.arguments()
                return EFFECT
            return TARGET
        if k in ("num", "str", "chr", "true", "false", "null"):
            self.p += 1
            return VALUE
        if k in ("this", "super"):
            self.p += 1
            if self.at("("):
                self.arguments()
                return EFFECT
            if k == "super" and not self.at(".", "::"):
                self.fail("unexpected")
            return VALUE
        if k == "(":
            self.p += 1
            kind = self.expression()
            self.need(")")
            return TARGET if kind == TARGET else VALUE
        if k == "new":
            self.p += 1
            self.creator()
            return EFFECT
        if k == "switch":
            self.p += 1
            self.switch_rest()
            return EFFECT
        if k in PRIMITIVE or k == "void":
            self.p += 1
            self.dims()
            if self.at("::"):
                return VALUE
            self.need(".")
            self.need("class")
            return VALUE
        self.fail("expected an expression")
        return VALUE

    def creator(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.at("<"):
            self.type_arguments()
        if self.k[self.p] in PRIMITIVE:
            self.p += 1
        else:
            self.name()
            self.diamond()
            while self.eat("."):
                self.name()
                self.diamond()
        if self.at("["):
            sized = False
            while self.at("["):
                self.p += 1
                if not self.eat("]"):
                    self.expression()
                    self.need("]")
                    sized = True
            if self.at("{"):
                if sized:
                    self.fail("sized array with values")
                self.initializer()
            elif not sized:
                self.fail("array without a size")
            return
        self.arguments()
        if self.at("{"):
            self.class_body()

    def diamond(self) -> None:
        if self.at("<") and self.peek() == ">":
            self.p += 2
        else:
            self.type_arguments()


def parse(text: str) -> list[tuple[int, str]]:
    """Faults of a compilation unit: (offset, what)."""
    if text.startswith("\ufeff"):
        text = text[1:]
    return Java(lex(text), text).run()
