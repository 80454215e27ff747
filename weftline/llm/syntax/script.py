"""JavaScript and TypeScript, with JSX."""

from __future__ import annotations

import re

from weftline.llm.syntax.base import EOF, LexFault, Parser, Tokens, deep, punctuation, words

RESERVED = words(
    "break case catch class const continue debugger default delete do else export extends false finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with enum"
)
BEFORE_VALUE = words("return typeof instanceof in of new delete void throw case do else extends default await yield")
NAME = r"(?:[A-Za-z_$]|[^\x00-\x7f\s]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
PART = r"(?:[A-Za-z0-9_$\u200c\u200d]|[^\x00-\x7f\s]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
SPACE = re.compile(r"(?:[ \t\v\f\u00a0\ufeff\u2000-\u200a\u3000\u1680\u202f\u205f]+|//[^\n\r\u2028\u2029]*|(?P<nl>[\n\r\u2028\u2029])|/\*(?P<c>(?:[^*]|\*(?!/))*)\*/)")
TOKEN = re.compile(
    r"(?P<id>%s%s*)|(?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?"
    r"|(?:[0-9]+(?:_[0-9]+)*)(?:n(?![A-Za-z0-9_$])|(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?)|\.[0-9]+(?:_[0-9]+)*(?:[eE][+-]?[0-9]+)?)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<priv>#%s%s*)|(?P<op>%s)"
    % (NAME, PART, NAME, PART, punctuation(
        "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << <<= & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= "
        ">>= >>>= &= |= ^= &&= ||= ??= => . ... @"
    ))
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(?P<flags>[A-Za-z]*)")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
TAG_NAME = re.compile(r"%s(?:%s|-)*(?:[.:]%s(?:%s|-)*)*" % (NAME, PART, NAME, PART))
BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")
JUNK = re.compile(r"[^\s>{][^\s>{/]*")
# lengths of the text that may be read in vain for elements without an end
MOST_LOST = 20
HEX_OR_ANY = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")


class Lexer:
    def __init__(self, text: str, jsx: bool, typed: bool):
        self.x, self.n, self.t, self.jsx, self.typed = text, len(text), Tokens(), jsx, typed
        self.i = 0
        self.names: list[str] = []
        self.inside = self.lost = 0

    def run(self) -> Tokens:
        if self.x.startswith("#!"):
            cut = self.x.find("\n")
            self.i = self.n if cut < 0 else cut
        deep(self.n)
        try:
            while self.code(False):
                pass
        except LexFault as f:
            self.t.faults.append((f.offset, f.what))
        return self.t.close(self.n)

    def value_follows(self) -> bool:
        """An operand, not an operator, comes next: `/` begins a regular expression and `<` an element."""
        if not self.t.kind:
            return True
        k = self.t.kind[-1]
        if k in ("id", "num", "str", "regex", "tmpl", "tmpl_close", "jsx_close", ")", "]", "priv", "this", "super", "null", "true", "false", "++", "--"):
            return False
        return k in BEFORE_VALUE or k not in RESERVED

    def blank(self) -> int:
        nl = 0
        while m := SPACE.match(self.x, self.i):
            if m.lastgroup == "nl" or (m["c"] and "\n" in m["c"]):
                nl = 1
            self.i = m.end()
        return nl

    def code(self, until_brace: bool) -> bool:
        """Tokens up to the end, or to the `}` that closes an embedded expression. False at the end."""
        x, add = self.x, self.t.add
        depth = 0
        while True:
            nl = self.blank()
            i = self.i
            if i >= self.n:
                if until_brace:
                    raise LexFault(i, "unterminated expression")
                return False
            c = x[i]
            if c == "`":
                self.template(nl)
                continue
            if c == "/" and self.value_follows():
                m = REGEX.match(x, i)
                if not m:
                    self.t.note(i, "unterminated comment" if x.startswith("/*", i) else "bad regular expression")
                    line = x.find("\n", i)
                    self.i = self.n if line < 0 or x.startswith("/*", i) else line
                    add("regex", i, self.i, nl)
                    continue
                if len(set(m["flags"])) != len(m["flags"]) or set(m["flags"]) - set("dgimsuvy"):
                    self.t.faults.append((i, "bad flags of a regular expression"))
                add("regex", i, m.end(), nl)
                self.i = m.end()
                continue
            if c == "<" and self.jsx and self.value_follows() and self.element_here(i):
                self.element(nl)
                continue
            m = TOKEN.match(x, i)
            if not m:
                what = "unterminated string" if c in "\"'" else f"unexpected character {c!r}"
                self.t.faults.append((i, what))
                line = x.find("\n", i)
                self.i = (self.n if line < 0 else line) if c in "\"'" else i + 1
                continue
            kind, s = m.lastgroup, m.group()
            e = m.end()
            if kind == "id":
                kind = s if s in RESERVED else "id"
            elif kind == "num":
                if e < self.n and (x[e].isalnum() or x[e] in "_$"):
                    self.t.faults.append((i, "bad number"))
            elif kind == "str":
                if "\\" in s and HEX_OR_ANY.search(s.replace("\\\\", "")):
                    self.t.faults.append((i, "bad escape"))
            elif kind == "op":
                kind = s
                if s == "?." and e < self.n and x[e].isdigit():
                    kind, e = "?", i + 1
                elif s == "{":
                    depth += 1
                elif s == "}":
                    if depth == 0 and until_brace:
                        return True
                    depth = max(0, depth - 1)
            add(kind, i, e, nl)
            self.i = e

    def template(self, nl: int) -> None:
        x, at = self.x, self.i
        self.i += 1
        first = True
        while True:
            m = TEMPLATE.match(x, self.i)
            self.i = m.end()
            if self.i >= self.n:
                raise LexFault(at, "unterminated template")
            if x[self.i] == "`":
                self.i += 1
                self.t.add("tmpl" if first else "tmpl_close", at, self.i, nl)
                return
            self.i += 2
            self.t.add("tmpl_open" if first else "tmpl_mid", at, self.i, nl if first else 0)
            first = False
            self.code(True)
            self.i += 1

    def element_here(self, i: int) -> bool:
        m = TAG_NAME.match(self.x, i + 1)
        if not m:
            return self.x.startswith("<>", i)
        if self.typed:
            rest = self.x[m.end() : m.end() + 40].lstrip()
            return not (rest.startswith(",") or re.match(r"extends\s+[^=\s/>]", rest))
        return True

    def skip(self) -> None:
        self.i = BLANK.match(self.x, self.i).end()

    def braced(self) -> None:
        """{ expression } in an element."""
        self.t.add("jsx_{", self.i, self.i + 1, 0)
        self.i += 1
        self.code(True)
        self.t.add("jsx_}", self.i, self.i + 1, 0)
        self.i += 1

    def element(self, nl: int) -> None:
        t, at, names = self.t, self.i, self.names
        n, faults = len(t.kind), len(t.faults)
        t.add("jsx_open", at, at + 1, nl)
        self.names = []
        self.inside += 1
        try:
            self.tag()
        except LexFault as f:
            if self.inside > 1:
                raise
            # it ran to the end of the text: go on after its first line
            self.lost += self.n - at
            self.jsx = self.lost < MOST_LOST * self.n  # beyond, `<` is an operator and the parser notes it
            line = self.x.find("\n", at)
            self.i = self.n if line < 0 else line
            t.undo(n + 1, faults, self.i)
            t.note(f.offset if f.offset < self.i else at, f.what)
        finally:
            self.names = names
            self.inside -= 1
        t.add("jsx_close", self.i - 1, self.i, 0)

    def tag(self) -> None:
        """An element to its end. What does not belong there is noted and passed; only the end of the text is raised."""
        x, at, note = self.x, self.i, self.t.note
        self.i += 1
        m = TAG_NAME.match(x, self.i)
        name = ""
        if m:
            name, self.i = m.group(), m.end()
            while True:
                self.skip()
                if self.i >= self.n:
                    raise LexFault(at, "unterminated element")
                if x[self.i] == "{":
                    self.braced()
                    continue
                if x.startswith("/>", self.i):
                    self.i += 2
                    return
                if x[self.i] == ">":
                    break
                m = TAG_NAME.match(x, self.i)
                if not m:
                    note(self.i, "bad attribute")
                    self.i = JUNK.match(x, self.i).end()
                    continue
                self.i = m.end()
                self.skip()
                if self.i < self.n and x[self.i] == "=":
                    self.i += 1
                    self.skip()
                    c = x[self.i : self.i + 1]
                    if c in ('"', "'") and c:
                        end = x.find(c, self.i + 1)
                        if end < 0:
                            note(self.i, "unterminated attribute")
                            line = x.find("\n", self.i)
                            end = self.n - 1 if line < 0 else line
                        self.i = end + 1
                    elif c == "{":
                        self.braced()
                    elif c == "<":
                        self.tag()
                    else:
                        note(self.i, "bad attribute")
                        m = JUNK.match(x, self.i)
                        self.i = m.end() if m else self.i
        elif not x.startswith(">", self.i):
            note(self.i, "bad element")
            return
        self.i += 1
        self.names.append(name)
        while True:
            while self.i < self.n and x[self.i] not in "<{":
                if x[self.i] in ">}":
                    note(self.i, f"unexpected {x[self.i]} in an element")
                self.i += 1
            if self.i >= self.n:
                raise LexFault(at, "unterminated element")
            if x[self.i] == "{":
                self.braced()
            elif x.startswith("</", self.i):
                began = self.i
                self.i += 2
                self.skip()
                m = TAG_NAME.match(x, self.i)
                closes = m.group() if m else ""
                self.i = m.end() if m else self.i
                self.skip()
                self.names.pop()
                if closes != name or not x.startswith(">", self.i):
                    note(self.i, "closing tag does not match")
                    if closes != name and closes in self.names:
                        self.i = began  # it closes an outer element
                        return
                    if not x.startswith(">", self.i):
                        return
                self.i += 1
                return
            else:
                self.tag()


BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8,
    ">=": 8, "instanceof": 8, "in": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = words("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")
MODIFIERS = words("public private protected static readonly abstract override declare async accessor")
TARGET, PATTERN, OTHER = 2, 1, 0


class Script(Parser):
    typed = False

    def __init__(self, tokens: Tokens, text: str):
        super().__init__(tokens)
        self.x = text
        self.functions = self.inside = 0

    def attempt(self, rule) -> bool:
        held = self.functions, self.inside
        done = super().attempt(rule)
        if not done:
            self.functions, self.inside = held
        return done

    def word(self, i: int = 0) -> str:
        """The text of a name token, else ''."""
        j = self.p + i
        return self.x[self.t.start[j] : self.t.end[j]] if j < len(self.k) and self.k[j] == "id" else ""

    def semi(self) -> None:
        if self.eat(";"):
            return
        if self.at("}", EOF, "jsx_}") or self.nl[self.p]:
            return
        self.fail("expected ;")

    def name(self) -> None:
        self.need("id")

    def property_name(self) -> None:
        k = self.k[self.p]
        if k in ("id", "str", "num", "priv") or k in RESERVED:
            self.p += 1
        elif k == "[":
            self.p += 1
            self.assignment()
            self.need("]")
        else:
            self.fail("expected a property name")

    # statements
    def program(self) -> None:
        self.statements(self.statement)

    def block(self) -> None:
        self.need("{")
        self.inside += 1
        self.statements(self.statement, "}")
        self.inside -= 1
        self.need("}")

    def embedded(self, function: bool = False) -> None:
        """A statement where a declaration may not stand."""
        k = self.k[self.p]
        lexical = self.word() == "let" and (self.peek() == "[" or self.peek() in ("id", "{") and not self.nl[self.p + 1])
        if k in ("const", "class", "import", "export") and not (k == "import" and self.peek() in ("(", ".")) or lexical or k == "function" and not function:
            self.fail("a declaration may not stand here")
        self.statement()

    def statement(self) -> None:
        k = self.k[self.p]
        rule = self.RULES.get(k)
        if rule is not None:
            rule(self)
            return
        if k == "id":
            w = self.word()
            nxt = self.k[self.p + 1]
            if nxt == ":":
                self.p += 2
                self.embedded(True)
                return
            if w == "async" and nxt == "function" and not self.nl[self.p + 1]:
                self.p += 1
                self.function()
                return
            if w == "let" and nxt in ("id", "[", "{"):
                self.variables()
                self.semi()
                return
            if w == "using" and nxt == "id" and not self.nl[self.p + 1]:
                self.variables()
                self.semi()
                return
            if self.typed and not self.nl[self.p + 1] and self.typed_statement(w, nxt):
                return
        self.expression()
        self.semi()

    def typed_statement(self, w: str, nxt: str) -> bool:
        if w == "interface" and nxt == "id":
            self.p += 2
            self.type_parameters()
            if self.eat("extends"):
                self.heritage()
            self.object_type()
        elif w == "type" and nxt == "id":
            self.p += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.semi()
        elif w in ("namespace", "module", "global") and nxt in ("id", "str", "{"):
            self.p += 1
            named = not self.at("str")
            while self.at("id", "str", "."):
                self.p += 1
            if self.at("{") or named:
                held, self.inside = self.inside, -1  # its statements are those of a module
                self.block()
                self.inside = held
            else:
                self.semi()
        elif w == "declare" and (nxt in ("id", "class", "function", "const", "var", "enum", "import", "export")):
            self.p += 1
            self.statement()
        elif w == "abstract" and nxt == "class":
            self.p += 1
            self.class_()
        else:
            return False
        return True

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.p += 1
        self.condition()
        self.embedded(True)
        if self.eat("else"):
            self.embedded(True)

    def while_(self) -> None:
        self.p += 1
        self.condition()
        self.embedded()

    def do_(self) -> None:
        self.p += 1
        self.embedded()
        self.need("while")
        self.condition()
        self.eat(";")

    def for_(self) -> None:
        self.p += 1
        if self.word() == "await":
            self.p += 1
        self.need("(")
        if not self.at(";"):
            if self.at("var", "const") or (self.word() in ("let", "using") and self.peek() in ("id", "[", "{")):
                self.variables(in_for=True)
            else:
                self.expression(no_in=True)
            if self.at("in") or self.word() == "of":
                once = self.word() == "of"
                self.p += 1
                self.assignment() if once else self.expression()
                self.need(")")
                self.embedded()
                return
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.embedded()

    def jump(self) -> None:
        self.p += 1
        if self.at("id") and not self.nl[self.p]:
            self.p += 1
        self.semi()

    def return_(self) -> None:
        if not self.functions:
            self.fail("return outside a function")
        self.p += 1
        if not self.at(";", "}", EOF) and not self.nl[self.p]:
            self.expression()
        self.semi()

    def throw_(self) -> None:
        self.p += 1
        if self.nl[self.p]:
            self.fail("line break after throw")
        self.expression()
        self.semi()

    def try_(self) -> None:
        self.p += 1
        self.block()
        if self.eat("catch"):
            if self.eat("("):
                self.binding()
                self.need(")")
            self.block()
            if self.eat("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def switch_(self) -> None:
        self.p += 1
        self.condition()
        self.need("{")
        default = False
        while not self.eat("}"):
            if self.at("default") and not default:
                self.p += 1
                default = True
            else:
                self.need("case")
                self.expression()
            self.need(":")
            self.statements(self.statement, "case", "default", "}")

    def variables(self, in_for: bool = False) -> None:
        const = self.at("const")
        if const and self.typed and self.peek() == "enum":
            self.p += 1
            self.enum()
            return
        self.p += 1
        while True:
            pattern = not self.at("id")
            self.binding_target()
            if self.typed:
                self.eat("!")
            self.annotation()
            if self.eat("="):
                self.assignment(no_in=in_for)
            elif not in_for and (pattern or const) and not self.typed:
                self.fail("declaration without a value")
            if not self.eat(","):
                return

    def var_statement(self) -> None:
        enum = self.at("const") and self.peek() == "enum"
        self.variables()
        if not enum:
            self.semi()

    def debugger_(self) -> None:
        self.p += 1
        self.semi()

    def with_(self) -> None:
        self.while_()

    def enum(self) -> None:
        if not self.typed:
            self.fail("enum")
        self.p += 1
        self.name()
        self.need("{")

        def member():
            self.property_name()
            if self.eat("="):
                self.assignment()

        self.listed(member, "}")

    def import_(self) -> None:
        if self.peek() in ("(", "."):
            self.expression()
            self.semi()
            return
        if self.inside > 0:
            self.fail("an import inside a block")
        self.p += 1
        if self.eat("str"):
            self.import_attributes()
            self.semi()
            return
        if self.typed and self.word() == "type" and self.peek() in ("id", "{", "*") and not (self.word(1) == "from" and self.peek(2) == "str"):
            self.p += 1
        if self.at("id"):
            self.p += 1
            if self.typed and self.eat("="):
                self.expression()
                self.semi()
                return
            if not self.eat(","):
                self.from_()
                return
        if self.eat("*"):
            if self.word() != "as":
                self.fail("expected as")
            self.p += 1
            self.name()
        else:
            self.need("{")
            self.listed(self.specifier, "}")
        self.from_()

    def specifier(self) -> None:
        def one():
            if not (self.eat("str") or self.at("id") or self.k[self.p] in RESERVED):
                self.fail("expected a name")
            elif self.k[self.p - 1] != "str" or self.at("id"):
                self.p += 1 if (self.at("id") or self.k[self.p] in RESERVED) and self.k[self.p - 1] != "str" else 0

        if self.typed and self.word() == "type" and self.peek() not in (",", "}") and self.word(1) != "as":
            self.p += 1
        one()
        if self.word() == "as":
            self.p += 1
            one()

    def import_attributes(self) -> None:
        if (self.word() == "assert" or self.at("with")) and self.peek() == "{":
            self.p += 1
            self.object()

    def from_(self) -> None:
        if self.word() != "from":
            self.fail("expected from")
        self.p += 1
        self.need("str")
        self.import_attributes()
        self.semi()

    def export_(self) -> None:
        if self.inside > 0:
            self.fail("an export inside a block")
        self.p += 1
        if self.eat("default"):
            if self.at("function", "class", "@") or (self.word() == "async" and self.peek() == "function"):
                self.statement_or_anonymous()
            elif self.typed and self.word() in ("abstract", "interface") and self.peek() in ("class", "id"):
                self.statement()
            else:
                self.assignment()
                self.semi()
        elif self.eat("*"):
            if self.word() == "as":
                self.p += 1
                self.property_name()
            self.from_()
        elif self.at("{") or (self.typed and self.word() == "type" and self.peek() in ("{", "*")):
            if self.at("id"):
                self.p += 1
            if self.eat("*"):
                self.from_()
                return
            self.need("{")
            self.listed(self.specifier, "}")
            if self.word() == "from":
                self.from_()
            else:
                self.semi()
        elif self.typed and self.eat("="):
            self.expression()
            self.semi()
        elif self.at("function", "class", "const", "var", "@", "enum", "import") or self.at("id"):
            if self.at("id") and self.word() not in ("async", "let", "type", "interface", "namespace", "module", "declare", "abstract", "as"):
                self.fail("bad export")
            if self.at("id") and not self.typed and self.word() not in ("async", "let"):
                self.fail("bad export")
            self.statement()
        else:
            self.fail("bad export")

    def statement_or_anonymous(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.word() == "async":
            self.p += 1
        if self.at("class"):
            self.class_(True)
        else:
            self.function(True)

    def decorated(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.at("export"):
            self.export_()
        elif self.word() == "abstract":
            self.p += 1
            self.class_()
        else:
            self.class_()

    def decorator(self) -> None:
        self.need("@")
        if self.eat("("):
            self.expression()
            self.need(")")
            return
        self.name()
        while self.eat("."):
            self.property_name()
        if self.at("<"):
            self.type_arguments()
        if self.at("("):
            self.arguments()

    # functions and classes
    def function(self, anonymous: bool = False) -> None:
        self.need("function")
        self.eat("*")
        if not self.eat("id") and not anonymous:
            self.fail("expected a name")
        self.signature()
        self.body()

    def signature(self) -> None:
        self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.typed and self.eat(":"):
            self.return_type()

    def parameter(self) -> None:
        while self.at("@"):
            self.decorator()
        while self.typed and self.word() in MODIFIERS and self.peek() in ("id", "{", "["):
            self.p += 1
        rest = self.eat("...")
        if self.typed and self.at("this"):
            self.p += 1
        else:
            self.binding_target()
        if self.typed:
            self.eat("?")
        self.annotation()
        if self.at("="):
            if rest:
                self.fail("rest parameter with a value")
            self.p += 1
            self.assignment()

    def body(self) -> None:
        """A block, or in TypeScript nothing (an overload)."""
        if self.typed and not self.at("{"):
            self.semi()
            return
        self.functions += 1
        try:
            self.block()
        finally:
            self.functions -= 1

    def binding(self) -> None:
        self.binding_target()
        self.annotation()
        if self.eat("="):
            self.assignment()

    def binding_target(self) -> None:
        if self.eat("id"):
            return
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if not self.at("]"):
                    self.need(",")
        elif self.eat("{"):

            def one():
                if self.eat("..."):
                    self.binding_target()
                    return
                short = self.at("id")
                self.property_name()
                if self.eat(":"):
                    self.binding_target()
                elif not short:
                    self.fail("expected :")
                if self.eat("="):
                    self.assignment()

            self.listed(one, "}")
        else:
            self.fail("expected a name")

    def annotation(self) -> None:
        if self.typed and self.eat(":"):
            self.type()

    def class_(self, anonymous: bool = False) -> None:
        self.need("class")
        if self.at("id") and self.word() != "implements":
            self.p += 1
        elif not anonymous:
            self.fail("expected a name")
        self.type_parameters()
        if self.eat("extends"):
            self.unary_postfix()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.word() == "implements":
            self.p += 1
            self.heritage()
        self.need("{")
        self.statements(self.member, "}")
        self.need("}")

    def heritage(self) -> None:
        while True:
            self.type()
            if not self.eat(","):
                return

    def member(self) -> None:
        if self.eat(";"):
            return
        while self.at("@"):
            self.decorator()
        if self.word() == "static" and self.peek() == "{":
            self.p += 1
            self.functions += 1
            self.block()
            self.functions -= 1
            return
        while self.at("id") and (self.word() in MODIFIERS if self.typed else self.word() in ("static", "async", "accessor")):
            if self.peek() in ("(", "=", ";", "}", "<", "?", "!", ":", ",") or self.nl[self.p + 1]:
                break
            self.p += 1
        self.eat("*")
        if self.word() in ("get", "set") and self.peek() not in ("(", "=", ";", "}", "?", "!", ":", "<"):
            self.p += 1
        if self.typed and self.at("[") and self.peek() == "id" and self.peek(2) == ":":
            self.index_signature()
            self.semi()
            return
        self.property_name()
        if self.typed:
            if not self.eat("?"):
                self.eat("!")
        if self.at("(", "<"):
            self.signature()
            self.body()
            return
        self.annotation()
        if self.eat("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.semi()

    # expressions
    def expression(self, no_in: bool = False) -> int:
        kind = self.assignment(no_in)
        while self.eat(","):
            self.assignment(no_in)
            kind = OTHER
        return kind

    def arrow_here(self) -> bool:
        """An arrow function begins here; its parameters have not been read."""
        k = self.k[self.p]
        if k == "id":
            if self.peek() == "=>":
                return True
            if self.word() == "async" and not self.nl[self.p + 1]:
                if self.peek() == "id" and self.peek(2) == "=>":
                    return True
                if self.peek() == "(":
                    return self.arrow_after(self.closing(self.p + 1))
                return self.peek() == "<" and self.typed
            return False
        if k == "(":
            return self.arrow_after(self.closing(self.p))
        return k == "<" and self.typed

    def arrow_after(self, close: int) -> bool:
        nxt = self.k[close + 1] if close + 1 < len(self.k) else EOF
        return nxt == "=>" or (self.typed and nxt == ":")

    def arrow(self) -> None:
        if self.word() == "async" and self.peek() != "=>":
            self.p += 1
        if self.at("id"):
            self.p += 1
        else:
            self.type_parameters()
            self.need("(")
            self.listed(self.parameter, ")")
            if self.typed and self.eat(":"):
                self.return_type()
        if self.nl[self.p]:
            self.fail("line break before =>")
        self.need("=>")

    def assignment(self, no_in: bool = False) -> int:
        if self.word() == "yield" and self.functions:
            self.p += 1
            if not self.at(")", "]", "}", ",", ";", ":", EOF) and not self.nl[self.p]:
                self.eat("*")
                self.assignment(no_in)
            return OTHER
        if self.k[self.p] in ("id", "(", "<") and self.arrow_here() and self.attempt(self.arrow):
            if self.at("{"):
                self.functions += 1
                try:
                    self.block()
                finally:
                    self.functions -= 1
            else:
                self.assignment(no_in)
            return OTHER
        kind = self.conditional(no_in)
        k = self.k[self.p]
        if k in ASSIGN or (k == ">" and self.shift_assign()):
            if kind == OTHER or (kind == PATTERN and k != "="):
                self.fail("cannot assign")
            self.p += 1
            self.assignment(no_in)
            return OTHER
        return kind

    def shift_assign(self) -> bool:
        p = self.p
        while self.k[p] == ">" and self.k[p + 1] in (">", ">=") and self.adjacent(p + 1):
            p += 1
        if self.k[p] == ">=" and p > self.p:
            self.p = p
            return True
        return False

    def conditional(self, no_in: bool) -> int:
        kind = self.binary(0, no_in)
        if self.eat("?"):
            self.assignment()
            self.need(":")
            self.assignment(no_in)
            return OTHER
        return kind

    def binary(self, least: int, no_in: bool) -> int:
        kind = self.unary()
        while True:
            k = self.k[self.p]
            level = BINARY.get(k, 0)
            if k == "in" and no_in:
                return kind
            if k == "id" and self.typed and not self.nl[self.p] and self.word() in ("as", "satisfies") and 8 > least:
                self.p += 1
                if not self.eat("const"):
                    self.type()
                kind = TARGET if kind else OTHER
                continue
            if not level:
                return kind
            step = 1
            if k == ">":
                while self.k[self.p + step] == ">" and self.adjacent(self.p + step) and step < 3:
                    step += 1
                if self.k[self.p + step] == ">=" and self.adjacent(self.p + step):
                    return kind  # >>= or >>>=
                level = 8 if step == 1 else 9
            if level <= least and not (k == "**" and level == least):
                return kind
            self.p += step
            self.binary(level - 1 if k == "**" else level, no_in)
            kind = OTHER

    PREFIX = words("! ~ + - typeof void delete")

    def unary(self) -> int:
        k = self.k[self.p]
        if k in self.PREFIX:
            self.p += 1
            self.unary()
            if self.at("**"):
                self.fail("a sign before a power")
            return OTHER
        if k in ("++", "--"):
            self.p += 1
            if self.unary() != TARGET:
                self.fail("cannot assign")
            return OTHER
        if k == "id" and self.word() == "await" and self.peek() in ("id", "(", "new", "this", "import", "[", "function", "tmpl", "str", "super"):
            if not (self.peek() == "(" and not self.functions):
                self.p += 1
                self.unary()
                return OTHER
        if k == "<" and self.typed:
            self.p += 1
            self.type()
            self.need(">")
            self.unary()
            return OTHER
        kind = self.unary_postfix()
        if self.at("++", "--") and not self.nl[self.p]:
            if kind != TARGET:
                self.fail("cannot assign")
            self.p += 1
            return OTHER
        return kind

    def unary_postfix(self) -> int:
        kind = self.primary()
        while True:
            k = self.k[self.p]
            if k == ".":
                self.p += 1
                if not (self.at("id", "priv") or self.k[self.p] in RESERVED):
                    self.fail("expected a property name")
                self.p += 1
                kind = TARGET
            elif k == "?.":
                self.p += 1
                if self.at("("):
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                elif self.at("id", "priv") or self.k[self.p] in RESERVED:
                    self.p += 1
                elif not self.at("tmpl"):
                    self.fail("expected a property name")
                kind = OTHER
            elif k == "[":
                self.p += 1
                self.expression()
                self.need("]")
                kind = TARGET
            elif k == "(":
                self.arguments()
                kind = OTHER
            elif k in ("tmpl", "tmpl_open"):
                self.template()
                kind = OTHER
            elif k == "!" and self.typed and not self.nl[self.p] and kind != -1:
                self.p += 1
            elif k == "<" and self.typed and self.attempt(self.call_arguments):
                kind = OTHER
            else:
                return kind

    def call_arguments(self) -> None:
        self.type_arguments()
        if not self.at("(", "tmpl", "tmpl_open", ")", "]", ";", ",", ":", "?.", ".", "}", EOF):
            self.fail("no call")

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.spread, ")")

    def spread(self) -> None:
        self.eat("...")
        self.assignment()

    def template(self) -> None:
        if self.eat("tmpl"):
            return
        self.need("tmpl_open")
        while True:
            self.expression()
            if self.eat("tmpl_close"):
                return
            self.need("tmpl_mid")

    def primary(self) -> int:
        k = self.k[self.p]
        if k == "id":
            if self.word() == "async" and self.peek() == "function" and not self.nl[self.p + 1]:
                self.p += 1
                self.function(True)
                return OTHER
            self.p += 1
            return TARGET
        if k in ("num", "str", "regex", "this", "super", "null", "true", "false"):
            self.p += 1
            return OTHER
        if k in ("tmpl", "tmpl_open"):
            self.template()
            return OTHER
        if k == "(":
            self.p += 1
            kind = self.expression()
            self.need(")")
            return TARGET if kind == TARGET else OTHER
        if k == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.spread()
                if not self.at("]"):
                    self.need(",")
            return PATTERN
        if k == "{":
            self.object()
            return PATTERN
        if k == "function":
            self.function(True)
            return OTHER
        if k in ("class", "@"):
            while self.at("@"):
                self.decorator()
            self.class_(True)
            return OTHER
        if k == "new":
            self.p += 1
            if self.eat("."):
                self.name()
                return OTHER
            self.callee()
            if self.typed and self.at("<"):
                self.attempt(self.type_arguments)
            if self.at("("):
                self.arguments()
            return OTHER
        if k == "import":
            self.p += 1
            if self.eat("."):
                self.name()
            else:
                self.arguments()
            return OTHER
        if k == "priv":
            self.p += 1
            if not self.at("in"):
                self.fail("unexpected")
            return OTHER
        if k == "jsx_open":
            self.p += 1
            while not self.eat("jsx_close"):
                self.need("jsx_{")
                if not self.at("jsx_}"):
                    self.eat("...")
                    self.expression()
                self.need("jsx_}")
            return OTHER
        self.fail("expected an expression")
        return OTHER

    def callee(self) -> None:
        """What stands after new: members, no call."""
        self.primary()
        while True:
            if self.eat("."):
                self.property_name()
            elif self.eat("["):
                self.expression()
                self.need("]")
            else:
                return

    def object(self) -> None:
        self.need("{")
        self.listed(self.property, "}")

    def property(self) -> None:
        if self.eat("..."):
            self.assignment()
            return
        after = (",", ":", "(", "}", "=", "<")
        if self.word() == "async" and self.peek() not in after and not self.nl[self.p + 1]:
            self.p += 1
        star = self.eat("*")
        if self.word() in ("get", "set") and self.peek() not in after and not star:
            self.p += 1
        short = self.at("id")
        self.property_name()
        if self.at("(", "<"):
            self.signature()
            self.functions += 1
            try:
                self.block()
            finally:
                self.functions -= 1
        elif self.eat(":"):
            self.assignment()
        elif not short:
            self.fail("expected :")
        elif self.eat("="):
            self.assignment()

    # types
    def type_parameters(self) -> None:
        if not (self.typed and self.at("<")):
            return
        self.p += 1

        def one():
            while self.at("const", "in") or self.word() in ("out",) and self.peek() == "id":
                self.p += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()

        self.listed(one, ">")

    def type_arguments(self) -> None:
        self.need("<")
        self.listed(self.type, ">", trailing=False)

    def return_type(self) -> None:
        if self.word() == "asserts" and self.peek() in ("id", "this") and not self.nl[self.p + 1]:
            self.p += 2
            if self.word() == "is":
                self.p += 1
                self.type()
            return
        if self.at("id", "this") and self.word(1) == "is" and not self.nl[self.p + 1]:
            self.p += 2
        self.type()

    def type(self) -> None:
        if self.word() == "abstract" and self.peek() == "new":
            self.p += 1
        if self.at("new") or self.at("<"):
            self.eat("new")
            self.type_parameters()
            self.need("(")
            self.listed(self.parameter, ")")
            self.need("=>")
            self.return_type()
            return
        if self.at("(") and self.k[self.closing(self.p) + 1] == "=>":
            self.p += 1
            self.listed(self.parameter, ")")
            self.need("=>")
            self.return_type()
            return
        self.union()
        if self.at("extends") and not self.nl[self.p]:
            self.p += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        if not self.eat("|"):
            self.eat("&")
        while True:
            if self.at("(", "new", "<") and (not self.at("(") or self.k[self.closing(self.p) + 1] == "=>"):
                self.type()
                return
            self.type_operand()
            if not (self.eat("|") or self.eat("&")):
                return

    def type_operand(self) -> None:
        w = self.word()
        if w in ("keyof", "unique", "readonly", "infer") and self.peek() not in (",", ">", ")", ";", "]", "|", "&", "=", "}", "."):
            self.p += 1
            self.type_operand()
            if w == "infer" and self.at("extends"):
                p = self.p
                self.p += 1
                self.union()
                if self.at("?"):
                    self.p = p
            return
        k = self.k[self.p]
        if k == "id" or k in ("this", "null", "void", "true", "false", "num", "str", "typeof", "import", "-"):
            if k == "typeof":
                self.p += 1
                if self.at("import"):
                    self.type_operand()
                    return
            if k == "-":
                self.p += 1
                self.need("num")
            elif k == "import":
                self.p += 1
                self.need("(")
                self.need("str")
                self.need(")")
            else:
                if k == "typeof" and not self.at("id", "this"):
                    self.fail("expected a name")
                self.p += 1
            while self.eat("."):
                self.property_name()
            if self.at("<") and not self.nl[self.p]:
                self.type_arguments()
        elif k == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.p += 1

            def one():
                self.eat("...")
                if self.at("id") and (self.peek() == ":" or (self.peek() == "?" and self.peek(2) == ":")):
                    self.p += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")

            self.listed(one, "]")
        elif k == "{":
            self.object_type()
        elif k in ("tmpl", "tmpl_open"):
            if not self.eat("tmpl"):
                self.p += 1
                while True:
                    self.type()
                    if self.eat("tmpl_close"):
                        break
                    self.need("tmpl_mid")
        else:
            self.fail("expected a type")
        while self.at("[") and not self.nl[self.p]:
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.need(":")
        self.type()

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.type_member()
            if self.at("}"):
                continue
            if not (self.eat(";") or self.eat(",")) and not self.nl[self.p]:
                self.fail("expected ;")

    def type_member(self) -> None:
        if self.at("+", "-"):
            self.p += 1
        if self.word() == "readonly" and self.peek() not in (":", "?", "(", "<", ";", ",", "}"):
            self.p += 1
        if self.word() in ("get", "set") and self.peek() not in (":", "?", "(", "<", ";", ",", "}"):
            self.p += 1
        if self.at("["):
            if self.peek() == "id" and self.peek(2) == ":":
                self.p += 3
                self.type()
                self.need("]")
            elif self.peek() == "id" and self.peek(2) == "in":
                self.p += 3
                self.type()
                if self.word() == "as":
                    self.p += 1
                    self.type()
                self.need("]")
            else:
                self.property_name()
            if self.at("+", "-"):
                self.p += 1
        elif self.at("(", "<"):
            self.signature()
            return
        elif self.at("new") and self.peek() in ("(", "<"):
            self.p += 1
            self.signature()
            return
        else:
            self.property_name()
        self.eat("?")
        if self.at("(", "<"):
            self.signature()
        else:
            self.annotation()

    RULES = {}


Script.RULES = {
    "{": Script.block, ";": lambda s: s.eat(";"), "var": Script.var_statement, "const": Script.var_statement,
    "function": Script.function, "class": Script.class_, "@": Script.decorated, "if": Script.if_, "for": Script.for_,
    "while": Script.while_, "do": Script.do_, "break": Script.jump, "continue": Script.jump, "return": Script.return_,
    "throw": Script.throw_, "try": Script.try_, "switch": Script.switch_, "debugger": Script.debugger_,
    "with": Script.with_, "import": Script.import_, "export": Script.export_, "enum": Script.enum,
}


class Typed(Script):
    typed = True


def parse(text: str, typed: bool, jsx: bool) -> list[tuple[int, str]]:
    """Faults of a script: (offset, what)."""
    if text.startswith("\ufeff"):
        text = text[1:]
    tokens = Lexer(text, jsx, typed).run()
    return (Typed if typed else Script)(tokens, text).run()
