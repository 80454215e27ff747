"""Token streams of source files with their bracket table, for the extractors of facts.

One pass makes tokens; comments are set aside, strings and templates are single tokens with their value, elements in
scripts are split into names, attributes and texts. Every bracket knows its partner, so a declaration's body, parameters
or clause is found without counting again. Broken text gives what tokens it has; nothing is refused here.
"""

from __future__ import annotations

import re
from bisect import bisect_right

OPENERS = {"(": ")", "[": "]", "{": "}"}
ASSIGNMENTS = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_NAME = r"[A-Za-z_$\u00a2-\uffff][\w$\u00a2-\uffff]*"
_BLANK = r"(?P<blank>\s+|//[^\n]*)|(?P<doc>/\*(?:[^*]|\*(?!/))*(?:\*/)?)"
_OPS = r"(?P<op>=>|\.\.\.|\?\.(?!\d)|===|!==|\*\*=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^]=|->|::|\.\.=?|[^\s\w])"
_SCRIPT = re.compile(
    rf"{_BLANK}|(?P<id>#?{_NAME})|(?P<num>\.?\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<str>\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<tick>`)|{_OPS}"
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*")
_TAG = re.compile(r"<(?P<name>[A-Za-z_$][\w.$:-]*)?")
_GENERIC = re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b)")
_ATTRIBUTE = re.compile(r"\s*(?:/\*(?:[^*]|\*(?!/))*\*/\s*)?(?P<name>[A-Za-z_$][\w:.-]*)?(?P<eq>\s*=\s*)?")
_ATTRIBUTE_TEXT = re.compile(r"\"[^\"]*\"|'[^']*'")
_CHILD = re.compile(r"[^<{]*")
_AFTER_VALUE = frozenset(")]}") | {"id", "num", "str", "tmpl", "regex", "jsxend"}
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else await yield default extends".split())
_PLAIN = {
    "java": re.compile(rf"{_BLANK}|(?P<id>{_NAME})|(?P<num>\.?\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<str>\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')|{_OPS}"),
    "kotlin": re.compile(rf"(?P<blank>\s+|//[^\n]*)|(?P<nest>/\*)|(?P<id>{_NAME}|`[^`\n]+`)|(?P<num>\.?\d(?:[\w]|\.(?=\d)|(?<=[eE])[+-])*)|(?P<str>\"\"\"[\s\S]*?\"\"\"+|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')|{_OPS}"),
    "rust": re.compile(rf"(?P<blank>\s+|//[^\n]*)|(?P<nest>/\*)|(?P<str>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^'\\\n])')|(?P<life>'{_NAME})|(?P<id>(?:r#)?{_NAME})|(?P<num>\d(?:\w|\.(?=\d)|(?<=[eE])[+-])*)|{_OPS}"),
}


class Stream:
    """Tokens i: kind k[i] (for names and signs in `op`, also their text), text x[i], start s[i], end e[i], partner m[i] or -1."""

    def __init__(self, text: str):
        self.text = text
        self.k: list[str] = []
        self.x: list[str] = []
        self.s: list[int] = []
        self.e: list[int] = []
        self.m: list[int] = []
        self.docs: list[tuple[int, int]] = []
        self.open: list[int] = []
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def add(self, kind: str, start: int, end: int, value: str | None = None) -> None:
        i = len(self.k)
        self.k.append(kind)
        self.x.append(self.text[start:end] if value is None else value)
        self.s.append(start)
        self.e.append(end)
        self.m.append(-1)
        if kind in OPENERS:
            self.open.append(i)
        elif kind in (")", "]", "}"):
            while self.open:  # an opening bracket without its own closing one is dropped
                j = self.open.pop()
                if OPENERS[self.k[j]] == kind:
                    self.m[i], self.m[j] = j, i
                    break

    def line(self, i: int) -> int:
        return bisect_right(self.starts, self.s[i]) if i < len(self.s) else len(self.starts)

    def end_line(self, i: int) -> int:
        return bisect_right(self.starts, max(0, self.e[i] - 1)) if i < len(self.e) else len(self.starts)

    def end(self, i: int) -> int:
        """The number of the closing bracket of i, or of the last token."""
        return self.m[i] if self.m[i] >= 0 else len(self.k) - 1

    def at(self, i: int) -> str:
        return self.x[i] if 0 <= i < len(self.x) else ""

    def kind(self, i: int) -> str:
        return self.k[i] if 0 <= i < len(self.k) else ""


def _value(literal: str) -> str:
    """The text of a quoted literal, common escapes resolved."""
    body = literal[3:-3] if literal.startswith('"""') and len(literal) >= 6 else literal[1:-1]
    if "\\" not in body:
        return body
    return re.sub(r"\\(u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|\r?\n|[\s\S])", _escape, body)


def _escape(m: re.Match) -> str:
    code = m[2] or m[3] or m[4]
    if code:
        n = int(code, 16)
        return chr(n) if n < 0x110000 else "\ufffd"
    one = m[1]
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}.get(one, "" if one.endswith("\n") else one)


def plain(text: str, language: str) -> Stream:
    """Tokens of Java, Kotlin or Rust."""
    t, i, n, match = Stream(text), 0, len(text), _PLAIN[language].match
    while i < n:
        m = match(text, i)
        if not m:
            i += 1
            continue
        kind, i = m.lastgroup, m.end()
        if kind == "doc":
            t.docs.append((m.start(), i))
        elif kind == "nest":
            depth = 1
            for c in re.compile(r"/\*|\*/").finditer(text, i):
                depth += 1 if c.group() == "/*" else -1
                i = c.end()
                if not depth:
                    break
            else:
                i = n
            t.docs.append((m.start(), i))
        elif kind == "h":
            t.add("str", m.start(), i, m["str"].split('"', 1)[1].rsplit('"', 1)[0])
        elif kind == "str":
            s = m.group()
            t.add("str", m.start(), i, _value(s[s.index('"') if '"' in s else s.index("'") :]))
        elif kind != "blank":
            t.add(m.group() if kind == "op" else kind, m.start(), i)
    return t


def script(text: str, jsx: bool) -> Stream:
    """Tokens of a script. Kinds of elements: jsxname, jsxattr, jsxtext and jsxend; of templates: tmpl with the plain parts."""
    t, i, n = Stream(text), 0, len(text)
    # where the reader is: code (how many braces are open), the children of an element, or a template
    modes: list[list] = [["code", 0]]
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n

    def tag(i: int) -> int:
        """After an opening `<`: name and attributes up to a brace, or to the end of the tag."""
        while i < n:
            m = _ATTRIBUTE.match(text, i)
            i = m.end()
            if m["name"]:
                t.add("jsxattr", m.start("name"), m.end("name"))
            quoted = _ATTRIBUTE_TEXT.match(text, i) if m["eq"] else None
            if quoted:
                t.add("str", i, quoted.end(), quoted.group()[1:-1])
                i = quoted.end()
            elif text.startswith("{", i):
                t.add("{", i, i + 1)
                modes.append(["tag", 0])
                modes.append(["code", 0])
                return i + 1
            elif text.startswith("/>", i):
                t.add("jsxend", i, i + 2)
                return i + 2
            elif text.startswith(">", i):
                modes.append(["children", 0])
                return i + 1
            elif not m["name"]:
                if text.startswith("<", i):  # type arguments, or not a tag at all
                    return i + 1
                i += 1
        return i

    while i < n:
        mode = modes[-1]
        if mode[0] == "tag":
            modes.pop()
            i = tag(i)
            continue
        if mode[0] == "children":
            m = _CHILD.match(text, i)
            if m.group().strip():
                t.add("jsxtext", i, m.end(), " ".join(x.strip() for x in m.group().split("\n") if x.strip()))
            i = m.end()
            if text.startswith("</", i):
                i = text.find(">", i) + 1 or n
                t.add("jsxend", i - 1, i)
                modes.pop()
            elif text.startswith("<", i):
                m = _TAG.match(text, i)
                t.add("jsxname", i, m.end(), m["name"] or "")
                i = tag(m.end())
            elif i < n:
                t.add("{", i, i + 1)
                modes.append(["code", 0])
                i += 1
            continue
        if mode[0] == "template":
            m = _TEMPLATE.match(text, i)
            t.add("tmpl", i, m.end())
            i = m.end()
            if text.startswith("${", i):
                t.add("{", i + 1, i + 2)
                modes.append(["code", 0])
                i += 2
            else:
                modes.pop()
                i += 1
            continue
        c = text[i]
        last = t.k[-1] if t.k else ""
        value = not last or last not in _AFTER_VALUE or (last == "id" and t.x[-1] in _BEFORE_VALUE)
        if c == "/" and value and (m := _REGEX.match(text, i)):
            t.add("regex", i, m.end())
            i = m.end()
            continue
        if c == "<" and jsx and value and re.compile(r"<[A-Za-z_$>]").match(text, i) and not _GENERIC.match(text, i):
            m = _TAG.match(text, i)
            t.add("jsxname", i, m.end(), m["name"] or "")
            i = tag(m.end())
            continue
        m = _SCRIPT.match(text, i)
        if not m:
            i += 1
            continue
        kind, start, i = m.lastgroup, i, m.end()
        if kind == "blank":
            continue
        if kind == "doc":
            if m.group().startswith("/**"):
                t.docs.append((start, i))
        elif kind == "tick":
            modes.append(["template", 0])
        elif kind == "str":
            t.add("str", start, i, _value(m.group()))
        elif kind == "op":
            s = m.group()
            if s == "{":
                mode[1] += 1
            elif s == "}":
                if mode[1] == 0 and len(modes) > 1:
                    modes.pop()
                mode[1] -= 1
            t.add(s, start, i)
        else:
            t.add(kind, start, i)
    return t
