"""Directly addressable codes: a byte layout for lists of token ids.

An id is split into chunks of eight bits, lowest first.  Level k holds chunk k
of every id that reaches it, a bitmap with one continuation bit for each of
those chunks, and a rank directory with the number of set bits before each
block of 512 bits.  Any id is read by one probe and at most one rank per level;
nothing before it is decoded.

Layout, little-endian: ``DAC1``, u32 number of documents, u64 number of ids,
u32 number of levels, u64 first document bound (documents + 1 bounds), then per
level u64 chunk count, chunks, padding to 8, bitmap words (u64), directory (u32).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BITS = 8
BLOCK = 512


def pack(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """Encode unsigned ids of documents ``ids[bounds[i]:bounds[i + 1]]``."""
    bounds = np.asarray(bounds, np.uint64)
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        levels.append((rest.astype(np.uint8), bits, directory))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(BITS)
    out = [MAGIC, struct.pack("<IQI", len(bounds) - 1, len(ids), len(levels)), bounds.tobytes()]
    for chunks, bits, directory in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bytes(-len(chunks) % 8), bits.tobytes(), directory.tobytes()]
    return b"".join(out)


class Reader:
    """Reads a packed list; ``reader[i]`` is one id, ``ids()`` all of them."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        docs, self.count, levels = struct.unpack_from("<IQI", blob, 4)
        at = 20
        self.bounds = np.frombuffer(blob, np.uint64, docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            chunks = np.frombuffer(blob, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            size = -(-n // BLOCK) * (BLOCK // 8)
            bits = np.frombuffer(blob, np.uint8, size, at)
            at += size
            directory = np.frombuffer(blob, np.uint32, size * 8 // BLOCK + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(directory[block]) + int(before[: i - block * BLOCK].sum())
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(self.count, np.uint32)
        where = np.arange(self.count)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(BITS * k)
            where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
        return out

    def document(self, d: int) -> np.ndarray:
        """Ids of document d, each read by its own address."""
        return np.array([self[i] for i in range(self.bounds[d], self.bounds[d + 1])], np.uint32)
