"""Vectorised structural index of many JSON texts at once.

All texts of a batch stand in one byte buffer. Bitmaps mark quotes, escapes, brackets and delimiters; parity of quotes
gives what lies in strings; prefix sums of brackets give the nesting depth; one pass over tokens sorted by depth links
every token to the bracket that holds it. From that come validity (RFC 8259) and the spans of all values without a loop
over characters or brackets; numbers and literals are checked, and key names and wanted values read, one by one.
"""

from __future__ import annotations

import json
import re

import numpy as np

WS, OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA, STR, SCALAR = range(1, 10)

_CLASS = np.zeros(256, np.int8)
for _b, _c in ((" \t\n\r", WS), ("{", OPEN_O), ("}", CLOSE_O), ("[", OPEN_A), ("]", CLOSE_A), (":", COLON), (",", COMMA)):
    for _x in _b:
        _CLASS[ord(_x)] = _c
_HEX = np.zeros(256, bool)
_HEX[[ord(x) for x in "0123456789abcdefABCDEF"]] = True
_ESC = np.zeros(256, bool)
_ESC[[ord(x) for x in '"\\/bfnrtu']] = True
_VALUE_START = np.isin(np.arange(10), (OPEN_O, OPEN_A, STR, SCALAR))
_SCALAR_RE = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def _unescape(raw: bytes) -> str:
    if b"\\" not in raw:
        return raw.decode("utf-8", "replace")
    return json.loads(b'"' + raw + b'"')


class StructuralIndex:
    """Values of a list of JSON texts as arrays.

    valid[doc]; and for each value: doc, parent (a value number, -1 for a root), pos (position among its siblings),
    kind (OPEN_O, OPEN_A, STR, SCALAR), start and end (byte span; of a string without its quotes), key (bytes number
    into `keys`, -1 outside objects). Of a repeated key in one object the last value counts (`live`).
    """

    def __init__(self, texts: list[bytes]):
        n_docs = len(texts)
        self.buffer = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.buffer, np.uint8)
        lengths = np.fromiter((len(x) for x in texts), np.int64, n_docs)
        starts = np.zeros(n_docs, np.int64)
        np.cumsum(lengths[:-1] + 1, out=starts[1:])
        valid = np.ones(n_docs, bool)

        def doc_of(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(starts, at, "right") - 1

        # escapes: in each run of backslashes every other one escapes the next byte
        bs = np.flatnonzero(buf == 0x5C)
        escapers = bs
        if bs.size:
            head = np.ones(bs.size, bool)
            head[1:] = np.diff(bs) != 1
            run_start = bs[np.maximum.accumulate(np.where(head, np.arange(bs.size), 0))]
            escapers = bs[(bs - run_start) % 2 == 0]
        quote = buf == 0x22
        quote[escapers + 1] = False
        q = np.flatnonzero(quote)
        qdoc = doc_of(q)
        count = np.bincount(qdoc, minlength=n_docs)
        valid &= count % 2 == 0
        first = np.zeros(n_docs, np.int64)
        np.cumsum(count[:-1], out=first[1:])
        rank = np.arange(q.size) - first[qdoc]
        even = valid[qdoc]
        opening, closing = q[even & (rank % 2 == 0)], q[even & (rank % 2 == 1)]
        step = np.zeros(buf.size + 1, np.int8)
        step[opening] = 1
        step[closing] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)  # opening quote to the byte before the closing one
        bad = np.flatnonzero(inside & (buf < 0x20))
        valid[doc_of(bad)] = False
        esc_in = escapers[inside[escapers]]
        if esc_in.size:
            after = buf[esc_in + 1]
            wrong = ~_ESC[after]
            u = esc_in[after == ord("u")]
            if u.size:
                four = buf[np.minimum(u[:, None] + np.arange(2, 6), buf.size - 1)]
                valid[doc_of(u[~_HEX[four].all(1)])] = False
            valid[doc_of(esc_in[wrong])] = False

        cls = _CLASS[buf]
        cls[cls == 0] = SCALAR
        cls[inside] = 0
        cls[closing] = 0
        scalar = cls == SCALAR
        begins = scalar.copy()
        begins[1:] &= ~scalar[:-1]
        mark = np.where((cls >= OPEN_O) & (cls <= COMMA), cls, 0).astype(np.int8)
        mark[begins] = SCALAR
        mark[opening] = STR
        tok = np.flatnonzero(mark)
        tdoc = doc_of(tok)
        keep = valid[tdoc]
        tok, tdoc = tok[keep], tdoc[keep]
        kind = mark[tok]

        def prune(ok_docs: np.ndarray):
            nonlocal tok, tdoc, kind
            k = ok_docs[tdoc]
            if not k.all():
                tok, tdoc, kind = tok[k], tdoc[k], kind[k]

        def depth_now():
            opens, closes = (kind == OPEN_O) | (kind == OPEN_A), (kind == CLOSE_O) | (kind == CLOSE_A)
            level = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))
            return opens, closes, level

        # bracket balance of each text; unbalanced ones leave before anything is matched
        opens, closes, level = depth_now()
        new_doc = np.ones(tok.size, bool)
        new_doc[1:] = tdoc[1:] != tdoc[:-1]
        heads = np.flatnonzero(new_doc)
        has = np.zeros(n_docs, bool)
        has[tdoc] = True
        valid &= has
        if tok.size:
            base = np.zeros(heads.size, np.int64)
            base[1:] = level[heads[1:] - 1]
            own = level - np.repeat(base, np.diff(np.append(heads, tok.size)))
            valid[tdoc[own < 0]] = False
            last = np.append(heads[1:], tok.size) - 1
            valid[tdoc[last][own[last] != 0]] = False
            prune(valid)
            opens, closes, level = depth_now()
        n = tok.size
        opens_at = np.flatnonzero(opens)
        # the container level of a token: that of its siblings; a closing bracket belongs to what it closes
        member = np.where(opens, level - 1, np.where(closes, level + 1, level))
        lv = np.concatenate([level[opens_at], member]).astype(np.int32)
        idx = np.concatenate([opens_at, np.arange(n)])
        order = np.lexsort((idx, lv))
        holder = np.where(order < opens_at.size, idx[order], -1)
        seq = np.maximum.accumulate(np.where(holder >= 0, np.arange(holder.size), 0)) if n else np.zeros(0, np.int64)
        found = holder[seq] if n else holder
        holds = np.full(n, -1, np.int64)
        is_member = order >= opens_at.size
        holds[idx[order][is_member]] = found[is_member]
        holds[member == 0] = -1
        # grammar: what may stand after what, in which container
        prev = np.zeros(n, np.int8)
        prev[1:] = kind[:-1]
        new_doc = np.ones(n, bool)
        new_doc[1:] = tdoc[1:] != tdoc[:-1]
        prev[new_doc] = 0
        in_kind = np.where(holds >= 0, kind[holds], 0) if n else kind
        in_o, in_a = in_kind == OPEN_O, in_kind == OPEN_A
        is_key = (kind == STR) & in_o & ((prev == OPEN_O) | (prev == COMMA))
        prev_key = np.zeros(n, bool)
        prev_key[1:] = is_key[:-1]
        value_end = np.isin(prev, (STR, SCALAR, CLOSE_O, CLOSE_A)) & ~prev_key
        starts_value = _VALUE_START[kind]
        ok = np.zeros(n, bool)
        ok |= starts_value & (new_doc | (in_a & ((prev == OPEN_A) | (prev == COMMA))) | (in_o & (prev == COLON)))
        ok |= is_key
        ok |= (kind == COLON) & prev_key & in_o
        ok |= (kind == COMMA) & value_end & (in_o | in_a)
        ok |= (kind == CLOSE_O) & in_o & ((prev == OPEN_O) | value_end)
        ok |= (kind == CLOSE_A) & in_a & ((prev == OPEN_A) | value_end)
        valid[tdoc[~ok]] = False
        # scalars
        scalar_ends = np.flatnonzero(scalar[:-1] & ~scalar[1:]) + 1
        s_at = np.flatnonzero(kind == SCALAR)
        s_end = scalar_ends[np.searchsorted(scalar_ends, tok[s_at], "right")] if s_at.size else s_at
        data = self.buffer
        spelled: dict[bytes, bool] = {}
        good = np.ones(s_at.size, bool)
        for i, (a, b) in enumerate(zip(tok[s_at].tolist(), s_end.tolist())):
            x = data[a:b]
            v = spelled.get(x)
            if v is None:
                v = spelled[x] = _SCALAR_RE.fullmatch(x) is not None
            if not v:
                good[i] = False
        valid[tdoc[s_at[~good]]] = False

        # values
        v_at = np.flatnonzero(starts_value & ~is_key & valid[tdoc])
        number = np.full(n, -1, np.int64)
        number[v_at] = np.arange(v_at.size)
        self.valid, self.kind, self.doc = valid, kind[v_at], tdoc[v_at]
        up = holds[v_at]
        self.parent = np.where(up >= 0, number[up], -1) if v_at.size else up
        end = np.zeros(n, np.int64)
        if closing.size:
            strs = np.flatnonzero(kind == STR)
            end[strs] = closing[np.searchsorted(closing, tok[strs], "right")]
        end[s_at] = s_end
        shut = np.flatnonzero(closes)
        end[holds[shut]] = tok[shut] + 1
        self.start = tok[v_at] + (self.kind == STR)
        self.end = end[v_at]
        by_parent = np.argsort(self.parent, kind="stable")
        p = self.parent[by_parent]
        fresh = np.ones(p.size, bool)
        fresh[1:] = p[1:] != p[:-1]
        at = np.arange(p.size)
        self.pos = np.zeros(p.size, np.int64)
        self.pos[by_parent] = at - np.maximum.accumulate(np.where(fresh, at, 0)) if p.size else at
        named = np.flatnonzero((in_kind[v_at] == OPEN_O)) if v_at.size else v_at
        k_tok = v_at[named] - 2
        self.key = np.full(v_at.size, -1, np.int64)
        self.keys: dict[str, int] = {}
        raw: dict[bytes, int] = {}
        numbers = []
        for a, b in zip((tok[k_tok] + 1).tolist(), end[k_tok].tolist()):
            x = data[a:b]
            v = raw.get(x)
            if v is None:
                v = raw[x] = self.keys.setdefault(_unescape(x), len(self.keys))
            numbers.append(v)
        self.key[named] = numbers
        # of a repeated key the last one lives
        self.live = np.ones(v_at.size, bool)
        if named.size:
            o = np.lexsort((named, self.key[named], self.parent[named]))
            r = named[o]
            twin = (self.parent[r[1:]] == self.parent[r[:-1]]) & (self.key[r[1:]] == self.key[r[:-1]])
            self.live[r[:-1][twin]] = False

    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.parent < 0)

    def child(self, parents: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
        """(parent, child) value numbers of the members named `key` of the given objects."""
        k = self.keys.get(key)
        if k is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = np.flatnonzero((self.key == k) & self.live)
        c = c[np.isin(self.parent[c], parents[self.kind[parents] == OPEN_O])]
        return self.parent[c], c

    def elements(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parent, element) value numbers of the items of the given arrays, in order."""
        a = np.zeros(self.kind.size, bool)
        a[parents[self.kind[parents] == OPEN_A]] = True
        c = np.flatnonzero((self.parent >= 0) & a[self.parent])
        return self.parent[c], c

    def members(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parent, member) value numbers of all living members of the given objects."""
        a = np.zeros(self.kind.size, bool)
        a[parents[self.kind[parents] == OPEN_O]] = True
        c = np.flatnonzero((self.parent >= 0) & a[self.parent] & self.live)
        return self.parent[c], c

    def is_null(self, values: np.ndarray) -> np.ndarray:
        """null is the only scalar that begins with n."""
        buf = np.frombuffer(self.buffer, np.uint8)
        return (self.kind[values] == SCALAR) & (buf[self.start[values]] == ord("n"))

    def text(self, value: int) -> str | None:
        """A string's characters, another value's JSON text, None for null."""
        raw = self.buffer[self.start[value] : self.end[value]]
        if self.kind[value] == STR:
            return _unescape(raw)
        return None if self.kind[value] == SCALAR and raw == b"null" else raw.decode("utf-8", "replace")
