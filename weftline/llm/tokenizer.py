"""Byte-level BPE by speculation and verification.

A word is first cut by greedy longest match, walked for all new words of a batch at once through a trie held in arrays.
A cut is the exact encoding if and only if every two neighbouring tokens are compatible, that is, merging their joined
bytes gives back the same two tokens; all neighbouring pairs are tested at once by walking down the merge tables. Only
words with an incompatible pair are merged exactly, one by one. Words already seen by a worker are looked up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
SLICE_CHARS = 1 << 20
CACHE_WORDS = 400_000
LONG_WORD = 2000
NONE = np.int64(1) << 40
# fixed values: the word pattern of the public tokenizer, and the same for texts of ASCII characters only
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)


class _Trie:
    """All tokens' bytes; an edge is a sorted code of state and byte."""

    def __init__(self, tokens: list[bytes]):
        edges: dict[int, int] = {}
        ends: list[int] = [-1]
        for token, raw in enumerate(tokens):
            state = 0
            for byte in raw:
                code = state << 8 | byte
                nxt = edges.get(code)
                if nxt is None:
                    nxt = edges[code] = len(ends)
                    ends.append(-1)
                state = nxt
            ends[state] = token
        codes = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(codes)
        self.codes = codes[order]
        self.to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.ends = np.array(ends, np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        code = state << 8 | byte
        at = np.searchsorted(self.codes, code)
        at[at == self.codes.size] = 0
        return np.where(self.codes[at] == code, self.to[at], -1)


class Tokenizer:
    """The public byte-level BPE tokenizer `name`, read from `folder`. Special tokens' strings are ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER):
        import regex

        ranked: list[tuple[int, bytes]] = []
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            for line in f:
                if line.strip():
                    raw, rank = line.split()
                    ranked.append((int(rank), base64.b64decode(raw)))
        ranked.sort()
        self.tokens = [raw for _, raw in ranked]
        self.rank = {raw: i for i, raw in ranked}
        self.trie = _Trie(self.tokens)
        self.words, self.ascii_words = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self._merges()
        self.byte_token = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.exact_words = 0

    def _merges(self) -> None:
        """left[t], right[t]: the two tokens that merge to t; a single byte is its own halves. And pair -> token."""
        n = len(self.tokens)
        self.left, self.right = np.arange(n), np.arange(n)
        for t, raw in enumerate(self.tokens):
            if len(raw) > 1:
                parts = self._merge(raw, t)
                if len(parts) == 2:
                    self.left[t], self.right[t] = parts
        made = np.flatnonzero(self.left != np.arange(n))
        codes = self.left[made] << 32 | self.right[made]
        order = np.argsort(codes)
        self.pair_codes, self.pair_token = codes[order], made[order]

    def _merge(self, raw: bytes, limit: int | None = None) -> list[int]:
        """Exact merging by rank; with a limit only merges of a lower rank are made."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (limit is None or r < limit):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token two neighbours merge to, NONE if they do not."""
        code = a << 32 | b
        at = np.searchsorted(self.pair_codes, code)
        at[at == self.pair_codes.size] = 0
        return np.where(self.pair_codes[at] == code, self.pair_token[at], NONE)

    def _merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes): exact merging of many words in step, each round the lowest pair of every word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        buf = np.frombuffer(b"".join(words), np.uint8)
        token = self.byte_token[buf]
        word = np.repeat(np.arange(n), size)
        rank = np.full(token.size, NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank_of(token[inner], token[inner + 1])
        done_word, done_token = [], []
        while token.size:
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, head)
            length = np.diff(np.append(head, token.size))
            open_ = low != NONE
            if not open_.all():
                stay = np.repeat(open_, length)
                done_word.append(word[~stay]), done_token.append(token[~stay])
                token, word, rank = token[stay], word[stay], rank[stay]
                low, length = low[open_], length[open_]
                if not token.size:
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the first of equal pairs
            token[hit] = rank[hit]
            keep = np.ones(token.size, bool)
            keep[hit + 1] = False
            last = np.ones(hit.size, bool)
            inside = hit + 2 < token.size
            last[inside] = word[hit[inside] + 2] != word[hit[inside]]
            rank[hit] = NONE
            go = hit[~last]
            rank[go] = self._rank_of(token[go], token[go + 2])
            back = hit[(hit > 0)]
            back = back[word[back - 1] == word[back]]
            # merges of one round are in different words, so the left neighbour is not merged now
            rank[back - 1] = self._rank_of(token[back - 1], token[back])
            token, word, rank = token[keep], word[keep], rank[keep]
        word = np.concatenate(done_word) if done_word else word
        token = np.concatenate(done_token) if done_token else token
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=n)

    def _merge_long(self, raw: bytes) -> list[int]:
        """Exact merging of one long word: neighbours in a heap, so the time is n log n."""
        import heapq

        n = len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < n:
                r = self.rank.get(part[i] + part[nxt[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[nxt[i]])))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = nxt[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size or self.rank.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = b""
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            offer(prv[i])
        return [self.rank[p] for p in part if p]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of tokens stay as they are when their joined bytes are encoded.

        Undo the later of the two tokens step by step; the pair fails once the inner neighbours would have merged
        before the token that is undone came about.
        """
        out = np.ones(a.size, bool)
        idx = np.arange(a.size)
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(a.size, NONE)
        while idx.size:
            code = x << 32 | y
            at = np.searchsorted(self.pair_codes, code)
            at[at == self.pair_codes.size] = 0
            merged = (self.pair_codes[at] == code) & (self.pair_token[at] < limit)
            out[idx[merged]] = False
            # undo the half that was made last; ties go to the right one, whose merge comes later in the text
            undo_x = x > y
            nx, ny = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            limit = np.where(undo_x, x, y + 1)
            stuck = (nx == x) & (ny == y)
            # the later half is one byte: the other half is undone instead, if it can be
            other_x, other_y = stuck & ~undo_x, stuck & undo_x
            nx, ny = np.where(other_x, self.right[x], nx), np.where(other_y, self.left[y], ny)
            limit = np.where(other_x, x, np.where(other_y, y + 1, limit))
            go = ~merged & ~((nx == x) & (ny == y))
            idx, x, y, limit = idx[go], nx[go], ny[go], limit[go]
        return out

    def _greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of the words by longest match, all words in step."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        base = np.zeros(n, np.int64)
        np.cumsum(size[:-1], out=base[1:])
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        end = base + size
        which, pos = np.flatnonzero(size > 0), base[size > 0]
        got_word, got_token = [], []
        while which.size:
            state, at = np.zeros(which.size, np.int64), pos.copy()
            best, best_at = np.full(which.size, -1, np.int64), pos.copy()
            live = np.arange(which.size)
            while live.size:
                nxt = self.trie.step(state[live], buf[at[live]])
                ok = nxt >= 0
                live, nxt = live[ok], nxt[ok]
                state[live] = nxt
                at[live] += 1
                token = self.trie.ends[nxt]
                hit = token >= 0
                best[live[hit]] = token[hit]
                best_at[live[hit]] = at[live[hit]]
                live = live[at[live] < end[which[live]]]
            got_word.append(which), got_token.append(best)
            more = best_at < end[which]
            which, pos = which[more], best_at[more]
        word = np.concatenate(got_word) if got_word else np.zeros(0, np.int64)
        token = np.concatenate(got_token) if got_token else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=n)
        return token[order], np.concatenate([[0], np.cumsum(counts)])

    def _learn(self, fresh: list[str]) -> None:
        """Encode words not seen before and keep them."""
        raw = [w.encode("utf-8", "replace") for w in fresh]
        token, off = self._greedy(raw)
        word = np.repeat(np.arange(len(raw)), np.diff(off))
        bad = np.zeros(len(raw), bool)
        if token.size > 1:
            inner = word[1:] == word[:-1]
            a, b = token[:-1][inner], token[1:][inner]
            pairs, back = np.unique(a << 32 | b, return_inverse=True)
            fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            bad[word[1:][inner][~fits[back]]] = True
        redo = np.flatnonzero(bad)
        self.exact_words += redo.size
        if redo.size:
            sizes = np.diff(off)
            long = [i for i in redo.tolist() if len(raw[i]) > LONG_WORD]
            short = np.setdiff1d(redo, np.array(long, np.int64))
            exact, n_exact = self._merge_all([raw[i] for i in short.tolist()])
            of = np.concatenate([word[~bad[word]], np.repeat(short, n_exact)])
            token = np.concatenate([token[~bad[word]], exact])
            sizes[short] = n_exact
            for i in long:
                one = self._merge_long(raw[i])
                sizes[i] = len(one)
                of, token = np.concatenate([of, np.full(len(one), i)]), np.concatenate([token, np.array(one, np.int64)])
            token = token[np.argsort(of, kind="stable")]
            off = np.concatenate([[0], np.cumsum(sizes)])
        start = len(self.number)
        self.number.update(zip(fresh, range(start, start + len(fresh))))
        self.first = np.concatenate([self.first, off[1:] + self.flat.size])
        self.flat = np.concatenate([self.flat, token.astype(np.int32)])

    def split(self, text: str) -> list[str]:
        return (self.ascii_words if text.isascii() else self.words)(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; a null or empty text has none."""
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, x in enumerate(texts):
            for piece in _pieces(x):
                words += self.split(piece)
            ends[i + 1] = len(words)
        if len(self.number) > CACHE_WORDS:
            self.number, self.flat, self.first = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        known = self.number
        fresh = list(dict.fromkeys(w for w in words if w not in known)) if words else []
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        size = self.first[at + 1] - self.first[at]
        done = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(done[-1]) + np.repeat(self.first[at] - done[:-1], size)
        return self.flat[take], done[ends]


def _pieces(text: str | None) -> Iterator[str]:
    """A long text in parts cut before line feeds that follow visible characters: no word reaches over such a place."""
    if not text:
        return
    at, n = 0, len(text)
    while n - at > SLICE_CHARS:
        cut = text.find("\n", at + SLICE_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find("\n", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


_held: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(name: str, folder: str) -> Tokenizer:
    """One tokenizer per worker process."""
    if (name, folder) not in _held:
        _held[name, folder] = Tokenizer(name, folder)
    return _held[name, folder]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x) if x else 0
        if size >= SLICE_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_texts(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    Defined results. A null and an empty text have an empty list. Strings that look like special tokens are ordinary
    text. Repeated rows and rows with a null key are kept as they are. Very long texts are cut into words part by part,
    at places no word can span. Other columns are not read. An empty table gives no rows.
    """
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                ids, off = t.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], schema=schema)

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, ids array<int>")


def count_tokens(docs: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """All columns of `docs` but the text, and n_tokens: its size in tokens, 0 for null and empty texts."""
    rest = [c for c in docs.columns if c != text]
    shape = docs.select(*rest).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            sizes = [np.diff(t.encode(texts[lo:hi])[1]) for lo, hi in _slices(texts)]
            n = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return docs.select(*rest, text).mapInArrow(run, shape)
