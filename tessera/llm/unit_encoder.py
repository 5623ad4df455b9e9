"""Exact tokenizer output at the price of encoding each distinct piece once.

Both vocabularies used here cut a text into pieces (runs of letters, of digits,
of other signs; a byte-level piece may begin with one blank) and merge only
inside a piece, so a text's ids are its pieces' ids end to end.  Texts made of
ASCII and of the Latin-1 letters are cut here with numpy and their distinct
pieces given to the tokenizer's own model; any other text (apostrophes and ``<``
included, which begin contractions and special tokens) is given to the
tokenizer whole.  Both ways yield the library's ids.

Pieces are told apart by 64-bit hashes: among the at most ``SLOTS`` pieces a
worker remembers, two collide with a probability below 1e-6.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tessera.llm import wordkernel as wk
from tessera.llm.wordkernel import U64

SLOTS = 1 << 20
#: Ids kept before the memory of a worker is emptied.
MOST_IDS = 4_000_000

SLOW, LETTER, DIGIT, SIGN, BLANK = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    kind = np.full(256, SLOW, np.uint8)
    kind[0x21:0x7F] = SIGN
    for a, b in (("A", "Z"), ("a", "z")):
        kind[ord(a) : ord(b) + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[ord("'"), ord("<")]] = SLOW
    kind[0xC3] = LETTER  # with a continuation byte: U+00C0 to U+00FF
    kind[0x80:0xC0] = LETTER
    kind[wk.SPACE] = BLANK
    return kind


_KIND = _classes()
_VALUE = wk.mix64(np.arange(1000, 1256, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _alphabet() -> dict[int, str]:
    """Byte-level vocabularies write a byte that is no visible Latin-1 character as 256 + its rank."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


_ALPHABET = _alphabet()


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, in UTF-8."""
    out = _LOWER[data]
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[at]
        at = at[(second <= 0x9E) & (second != 0x97)]
        out[at] += 0x20
    return out


class UnitEncoder:
    """Encodes columns of texts; ``keeps_space`` for byte-level vocabularies.

    Without it the vocabulary folds case, drops white space and takes each digit
    for itself.  A null text is an empty one, which has no ids.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(SLOTS, U64)
        self.at = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the bounds of each text among them."""
        data, bounds = wk.text_bytes(column)
        n = len(bounds) - 1
        slow = self._slow(data, bounds)
        ids, out = self._fast(data, bounds, slow)
        if slow.any():
            raw = data.tobytes()
            parts = np.split(ids, out[1:-1])
            for d in np.flatnonzero(slow):
                text = raw[bounds[d] : bounds[d + 1]].decode("utf-8", "replace")
                parts[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            out = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts) if n else ids
        return ids, out

    @staticmethod
    def _slow(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        slow = np.zeros(len(bounds) - 1, bool)
        odd = np.flatnonzero(_KIND[data] == SLOW)
        lead = np.flatnonzero(data == 0xC3)
        second = data[np.minimum(lead + 1, len(data) - 1)] if len(data) else lead
        odd = np.concatenate([odd, lead[(second == 0x97) | (second == 0xB7)]])
        slow[np.searchsorted(bounds, odd, "right") - 1] = True
        return slow

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        kind = _KIND[data]
        begin = np.empty(n, bool)
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin[bounds[:-1][bounds[:-1] < n]] = True
        if not self.keeps_space:
            begin |= kind == DIGIT
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], n)
            solid = kind[starts] != BLANK
            return starts[solid], ends[solid]
        head = begin & (kind != BLANK)
        head[0] = False
        head[bounds[:-1][bounds[:-1] < n]] = False
        after = np.flatnonzero(head)  # pieces that follow something in their own text
        after = after[kind[after - 1] == BLANK]
        begin[after - 1] = True
        begin[after[data[after - 1] == 0x20]] = False
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n)

    def _fast(self, data: np.ndarray, bounds: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if slow.any():  # cut those texts out
            keep = np.repeat(~slow, np.diff(bounds))
            data = data[keep]
            bounds = np.concatenate([[0], np.cumsum(np.where(slow, 0, np.diff(bounds)))]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if not self.keeps_space:
            data = lower_bytes(data)
        starts, ends = self._pieces(data, bounds)
        keys = wk.span_hashes(data, starts, ends, _VALUE if self.keeps_space else wk.WORD_VALUE)
        slot = (keys & U64(SLOTS - 1)).astype(np.int64)
        if self.used > MOST_IDS:
            self._forget()
        at, length = self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != keys)
        if len(miss):
            distinct, example, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            example = miss[example]
            new_at, new_length = self._learn(data.tobytes(), starts[example].tolist(), ends[example].tolist())
            at[miss], length[miss] = new_at[back], new_length[back]
            where = slot[example]
            self.key[where], self.at[where], self.length[where] = distinct, new_at, new_length
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        source = np.repeat(at - total[:-1], length) + np.arange(total[-1])
        return self.pool[source], total[np.searchsorted(starts, bounds)]

    def _learn(self, raw: bytes, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, table = self.tokenizer.model.tokenize, _ALPHABET
        flat: list[int] = []
        length = np.empty(len(starts), np.int64)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            found = tokenize(raw[a:b].decode("latin-1").translate(table))
            length[i] = len(found)
            flat.extend([t.id for t in found])
        need = self.used + len(flat)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), np.uint32)])
        self.pool[self.used : need] = flat
        at = self.used + np.cumsum(length) - length
        self.used = need
        return at, length


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, keeps_space: bool) -> UnitEncoder:
    """One encoder, with its memory, for each worker process."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = UnitEncoder(path, keeps_space)
    return _encoders[path, keeps_space]
