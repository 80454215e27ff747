"""A compressed bitmap over 32-bit ordinals.

Ordinals are split by their high 16 bits into chunks. A chunk holds either a sorted uint16 array (sparse) or 8 KiB of
packed bits (dense), whichever is smaller, so AND and AND-NOT run on whole words where the set is dense.
"""

from __future__ import annotations

import numpy as np

SPARSE_LIMIT = 4096


def _pack(low: np.ndarray) -> np.ndarray:
    if low.size <= SPARSE_LIMIT:
        return low.astype(np.uint16)
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _dense(chunk: np.ndarray) -> bool:
    return chunk.dtype == np.uint8


def _unpack(chunk: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16) if _dense(chunk) else chunk


def _has(chunk: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of the sorted values `low` the chunk holds."""
    if _dense(chunk):
        return (chunk[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1
    at = np.searchsorted(chunk, low)
    at[at == chunk.size] = 0
    return chunk[at] == low if chunk.size else np.zeros(low.size, bool)


class Bitmap:
    """A set of ordinals. Immutable."""

    __slots__ = ("chunks",)

    def __init__(self, chunks: dict[int, np.ndarray] | None = None):
        self.chunks = chunks or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "Bitmap":
        """From ordinals in any order; repeats are one."""
        u = np.unique(np.asarray(ordinals, np.int64))
        high = u >> 16
        cut = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _pack(part & 0xFFFF) for part in np.split(u, cut) if part.size})

    def _with(self, other: "Bitmap", keep_common: bool) -> "Bitmap":
        out: dict[int, np.ndarray] = {}
        for k, a in self.chunks.items():
            b = other.chunks.get(k)
            if b is None:
                if not keep_common:
                    out[k] = a
                continue
            if _dense(a) and _dense(b):
                words = a & b if keep_common else a & ~b
                n = int(np.unpackbits(words).sum())
                c = words if n > SPARSE_LIMIT else np.flatnonzero(np.unpackbits(words)).astype(np.uint16)
            else:
                low = _unpack(a)
                held = _has(b, low)
                c = _pack(low[held if keep_common else ~held])
            if c.size:
                out[k] = c
        return Bitmap(out)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, False)

    def and_(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, True)

    def ordinals(self) -> np.ndarray:
        parts = [(_unpack(c).astype(np.int64)) | (k << 16) for k, c in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(int(np.unpackbits(c).sum()) if _dense(c) else c.size for c in self.chunks.values())

    def split(self) -> list[tuple[int, bytes]]:
        """(high part, bytes of the low parts) of each chunk; see to_bytes()."""
        return [(k, Bitmap({0: c}).to_bytes()) for k, c in sorted(self.chunks.items())]

    def to_bytes(self) -> bytes:
        """Chunks in order: high part, form and size as int32, then the data."""
        out = []
        for k, c in sorted(self.chunks.items()):
            out += [np.array([k, _dense(c), c.size], np.int32).tobytes(), c.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes | None) -> "Bitmap":
        """Back from to_bytes(); None is the empty set."""
        chunks, at = {}, 0
        while data and at < len(data):
            k, dense, size = np.frombuffer(data, np.int32, 3, at).tolist()
            kind = np.uint8 if dense else np.uint16
            chunks[k] = np.frombuffer(data, kind, size, at + 12)
            at += 12 + size * np.dtype(kind).itemsize
        return cls(chunks)
