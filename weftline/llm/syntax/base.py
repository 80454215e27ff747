"""What all parsers share: a token stream with its bracket table, faults and panic-mode recovery.

Every statement of every file is parsed; nothing is remembered from one file to the next, so a verdict is a function of
the file alone. Recursion is bounded by the tokens of the file only (see deep()), so no depth of nesting is refused.
"""

from __future__ import annotations

import re
import sys


class Fault(Exception):
    """A place where the text cannot go on: token number (or -1) and what was wrong."""

    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


class LexFault(Exception):
    """A lexical fault at a character offset."""

    def __init__(self, offset: int, what: str):
        super().__init__(what)
        self.offset, self.what = offset, what


EOF = "EOF"
OPENERS = {"(": ")", "[": "]", "{": "}"}
CLOSERS = {")", "]", "}"}


class Tokens:
    """Kinds of tokens with their offsets; `nl[i]`: a line break stands before token i."""

    __slots__ = ("kind", "start", "end", "nl", "faults")

    def __init__(self):
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.nl = bytearray()
        self.faults: list[tuple[int, str]] = []

    def add(self, kind: str, start: int, end: int, nl: int) -> None:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        self.nl.append(nl)

    def note(self, at: int, what: str) -> None:
        """A lexical fault, once."""
        if not self.faults or self.faults[-1] != (at, what):
            self.faults.append((at, what))

    def undo(self, tokens: int, faults: int, offset: int) -> None:
        """Forget the tokens from a number on, and the faults from a number on that lie at or after an offset."""
        for x in (self.kind, self.start, self.end, self.nl):
            del x[tokens:]
        self.faults[faults:] = [f for f in self.faults[faults:] if f[0] < offset]

    def close(self, size: int) -> "Tokens":
        for _ in range(4):
            self.add(EOF, size, size, 1)
        return self


def closers(kinds: list[str], last: int) -> dict[int, int]:
    """Opening bracket -> the bracket that ends its group, both as token numbers, in one pass."""
    open_, out = [], {}
    for i in range(last):
        k = kinds[i]
        if k in OPENERS:
            open_.append(i)
        elif k in CLOSERS and open_:
            out[open_.pop()] = i
    return out


FRAMES_A_TOKEN = 64


def deep(n: int) -> None:
    """Let calls nest as deep as n tokens or characters can ask for. Calls of Python by Python use no C stack."""
    need = FRAMES_A_TOKEN * n + 10_000
    if sys.getrecursionlimit() < need:
        sys.setrecursionlimit(min(need, (1 << 31) - 1))


class Parser:
    """Base of the languages' parsers. A subclass gives lex(text) and program()."""

    def __init__(self, tokens: Tokens):
        self.t = tokens
        self.k, self.nl = tokens.kind, tokens.nl
        self.p = 0
        self.last = len(self.k) - 4
        self.faults: list[tuple[int, str]] = list(tokens.faults)
        self.close_of = closers(self.k, self.last)
        deep(self.last)

    # stream
    def at(self, *kinds: str) -> bool:
        return self.k[self.p] in kinds

    def peek(self, i: int = 1) -> str:
        j = self.p + i
        return self.k[j] if j < len(self.k) else EOF

    def eat(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.k[self.p] != kind:
            self.fail(f"expected {kind}")
        self.p += 1

    def fail(self, what: str):
        raise Fault(self.p, f"{what}, found {self.k[self.p]}")

    def adjacent(self, i: int) -> bool:
        """Token i touches the one before it."""
        return self.t.start[i] == self.t.end[i - 1]

    def attempt(self, rule) -> bool:
        """Try a rule; on a fault go back to where it began."""
        p = self.p
        try:
            rule()
            return True
        except Fault:
            self.p = p
            return False

    def closing(self, p: int) -> int:
        """The token number of the bracket that closes the one at p, or that of the end."""
        return self.close_of.get(p, self.last)

    # statements
    def statements(self, rule, *until: str) -> None:
        """Statements up to one of `until` (not eaten) or the end, with panic-mode recovery."""
        while self.k[self.p] not in until:
            if self.p >= self.last:
                return
            p = self.p
            try:
                rule()
                if self.p == p:
                    self.fail("unexpected")
            except Fault as f:
                self.recover(f, p, until)

    def recover(self, fault: Fault, began: int, until: tuple) -> None:
        """Panic mode: note the fault, skip to after the next `;` or to a `}` of the same level, and go on."""
        self.faults.append((self.t.start[min(fault.at, self.last)], fault.what))
        depth = 0
        self.p = max(self.p, began)
        while self.p < self.last:
            k = self.k[self.p]
            if k in OPENERS:
                depth += 1
            elif k in CLOSERS:
                if depth == 0 and k in until:
                    return
                depth = max(0, depth - 1)
                if depth == 0 and k == "}":
                    self.p += 1
                    return
            elif k == ";" and depth == 0:
                self.p += 1
                return
            self.p += 1

    def listed(self, rule, close: str, comma: str = ",", trailing: bool = True) -> None:
        """rule {, rule} close; the opening bracket is eaten."""
        while not self.eat(close):
            rule()
            if self.eat(close):
                return
            self.need(comma)
            if not trailing and self.at(close):
                self.fail("unexpected")

    def balanced(self) -> None:
        """One bracketed group of any tokens."""
        stack = []
        while True:
            k = self.k[self.p]
            if k in OPENERS:
                stack.append(OPENERS[k])
            elif k in CLOSERS:
                if not stack or stack.pop() != k:
                    self.fail("unbalanced")
            elif self.p >= self.last:
                self.fail("unbalanced")
            self.p += 1
            if not stack:
                return

    def run(self) -> list[tuple[int, str]]:
        try:
            self.program()
        except Fault as f:
            self.faults.append((self.t.start[min(f.at, self.last)], f.what))
        return sorted(self.faults)


def words(text: str) -> frozenset:
    return frozenset(text.split())


def punctuation(text: str) -> str:
    """A pattern for the operators, longest first."""
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))
