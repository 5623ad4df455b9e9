"""Vectorised word kernel shared by the text operators.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  All of
those are single bytes in UTF-8 and never occur inside a longer sequence, so
the kernel works on the raw bytes of an Arrow string column and never builds a
Python string per word.  Hashes are 64 bits wide.

Empty and null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes hashed at a time; bounds the scratch arrays to a few megabytes.
PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply) on unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


SPACE = _is_space()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
WORD_VALUE = mix64(np.arange(1, 257, dtype=U64))
WORD_VALUE[SPACE] = 0


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_BASE)


@dataclass
class Words:
    """Words of a run of texts; ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Word boundaries of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    n = len(data)
    if n == 0:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    edges = bounds[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    edges = bounds[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ascending span; bytes between spans must have value 0."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = ends[j - 1]
        up, down = _POWERS.get(int(hi - lo))
        v = value[data[lo:hi]]
        v *= up
        at = starts[i:j] - lo
        out[i:j] = np.add.reduceat(v, at) * down[at]
        i = j
    out += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix64(out)


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` folds A-Z first."""
    return span_hashes(words.data, words.starts, words.ends, WORD_VALUE[_LOWER] if lower else WORD_VALUE)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values of h (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, U64)
    base = 0xA0761D6478BD642F | 1
    done, out, step, width = 0, None, h, 1
    n = len(h) - k + 1
    rest = k
    while rest:
        if rest & 1:
            part = step[done : done + n]
            out = part.copy() if out is None else out * U64(pow(base, width, 1 << 64)) + part
            done += width
        rest >>= 1
        if rest:
            step = step[: len(step) - width] * U64(pow(base, width, 1 << 64)) + step[width:]
            width *= 2
    return mix64(out)


def windows_inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index of each k-word window inside one text, and windows per text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1], counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return base + within, counts


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most about ``most`` bytes (one row at least)."""
    _, bounds = text_bytes(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def fold_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-free 64-bit digest of each row ``values[first[i]:first[i + 1]]``."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(mix64(values ^ U64(0x2545F4914F6CDD1D)), out=total[1:])
    return mix64(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64))
