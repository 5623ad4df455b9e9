"""Best-fit packing after Martello and Toth's dominance reduction.

The instance is the histogram of piece lengths, which has at most ``capacity``
entries whatever the corpus, so the driver solves it whole:

1. *Reduction*: sets that provably dominate every other way to place their
   longest piece are fixed for good.  A piece whose exact complement exists is
   fixed with it; a piece with which no two of the shortest fit is fixed with
   the longest that fits, or alone.
2. *Best fit*: the remaining lengths are placed longest first, each into the
   open sequences with the least room that is enough; equal sequences are
   handled together as a pattern with a count.

The solution is a list of segments (length, ranks, sequences, offset); pieces
are ranked within their length and looked up there.  A piece's rank is its number
among those of its length in the task that cut it, plus the count of those of earlier
tasks, so no task holds all pieces of one length and nothing is sorted.  The driver
sees one count for each length.

A null text is empty.  Empty token lists are given by no one: every document has
at least its end id.  Repeated and null doc_ids are all packed, row by row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import wordkernel as wk
from tessera.llm.frames import map_batches, settle
from tessera.llm.unit_encoder import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class Solution:
    """Segments of a packing; sequences are numbered from 0."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {k: v for k, v in counts.items() if v}
        self.used: dict[int, int] = defaultdict(int)
        self.segments: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, pieces: int, first: int, each: int, offset: int) -> None:
        self.segments.append((length, self.used[length], first, each, offset))
        self.used[length] += pieces
        self.left[length] -= pieces
        if not self.left[length]:
            del self.left[length]

    def _fix(self, many: int, *lengths: int) -> None:
        """``many`` sequences, each with one piece of every length."""
        offset = 0
        for length in lengths:
            self._place(length, many, self.sequences, 1, offset)
            offset += length
        self.sequences += many
        self.fixed += many

    def _reduce(self) -> None:
        changed = True
        while changed and self.left:
            changed = False
            for a in sorted(self.left, reverse=True):
                b = self.capacity - a
                if a not in self.left or b > a:
                    continue
                if b == 0:
                    self._fix(self.left[a], a)
                elif b == a and self.left[a] > 1:
                    many = self.left[a] // 2
                    self._place(a, 2 * many, self.sequences, 2, 0)
                    self.sequences += many
                    self.fixed += many
                elif b != a and b in self.left:
                    self._fix(min(self.left[a], self.left[b]), a, b)
            while self.left:
                a = max(self.left)
                small = min(self.left)
                room = self.capacity - a
                others = {**self.left, a: self.left[a] - 1}
                if a + small > self.capacity:
                    self._fix(self.left[a], a)
                elif self._two_shortest(others) > room:
                    b = max((k for k, v in others.items() if v and k <= room), default=0)
                    # as many at once as there are: taking more away only lengthens the two shortest
                    if not b:
                        self._fix(self.left[a], a)
                    elif a == b:
                        many = self.left[a] // 2
                        self._place(a, 2 * many, self.sequences, 2, 0)
                        self.sequences += many
                        self.fixed += many
                    else:
                        self._fix(min(self.left[a], self.left[b]), a, b)
                else:
                    break
                changed = True

    @staticmethod
    def _two_shortest(counts: dict[int, int]) -> int:
        low = sorted(k for k, v in counts.items() if v)[:2]
        if not low:
            return 1 << 60
        if counts[low[0]] > 1:
            return 2 * low[0]
        return sum(low) if len(low) > 1 else 1 << 60

    def _best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences (first, many)
        for a in sorted(self.left, reverse=True):
            while self.left.get(a):
                room = min((r for r, runs in rooms.items() if r >= a and runs), default=0)
                if room:
                    first, many = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                else:
                    room, first, many = self.capacity, self.sequences, -(-self.left[a] // (self.capacity // a))
                    self.sequences += many
                each = room // a
                whole = min(many, self.left[a] // each)
                if whole:
                    self._place(a, whole * each, first, each, self.capacity - room)
                    self._keep(rooms, room - each * a, first, whole)
                rest = self.left.get(a, 0)
                if rest and whole < many:  # one more sequence takes fewer than `each`
                    self._place(a, rest, first + whole, rest, self.capacity - room)
                    self._keep(rooms, room - rest * a, first + whole, 1)
                    whole += 1
                self._keep(rooms, room, first + whole, many - whole)

    @staticmethod
    def _keep(rooms: dict, room: int, first: int, many: int) -> None:
        if room and many:
            rooms[room].append((first, many))

    def table(self) -> dict[str, np.ndarray]:
        rows = sorted(self.segments)
        names = ("length", "rank", "sequence", "each", "offset")
        # as narrow as the values allow: the table goes to every task
        return {n: (v := np.array([r[i] for r in rows], np.int64)).astype(np.min_scalar_type(int(v.max(initial=0)))) for i, n in enumerate(names)}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keeps_space: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; only longer documents are cut.

    ``part`` is the task and ``place`` the number of the piece among those of its length there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(vocabulary, keeps_space), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            for i, j in wk.slices(texts, 1 << 19):
                ids, bounds = code.encode(texts[i:j])
                total = np.diff(bounds) + 1
                each = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                first, last = bounds[:-1][doc] + start, bounds[:-1][doc] + start + length
                crc = [
                    zlib.crc32(raw[4 * a : 4 * b]) if b <= e else zlib.crc32(tail, zlib.crc32(raw[4 * a : 4 * e]))
                    for a, b, e in zip(first.tolist(), last.tolist(), bounds[1:][doc].tolist(), strict=True)
                ]
                doc_id = batch.column("doc_id")[i:j].take(pa.array(doc))
                order = np.argsort(length, kind="stable")
                run = np.searchsorted(length[order], length[order])
                place = np.empty(len(length), np.int64)
                place[order] = met[length[order]] + np.arange(len(length)) - run
                met += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64)), pa.array(np.full(len(doc), part, np.int32)), pa.array(place)],
                    names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECE_SCHEMA)


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, keeps_space: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The driver gathers one count for each length, at most capacity.
    """
    table = settle(pieces(docs, vocabulary, end_id, capacity, keeps_space))
    counts = settle(table.groupBy("length", "part").agg(F.count("*").alias("n")))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = Solution(by_length, capacity).table()
    spark = docs.sparkSession
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = table.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    shared = spark.sparkContext.broadcast(found)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        key = s["length"].astype(float) * 2.0**40 + s["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length.astype(float) * 2.0**40 + rank, "right") - 1
            first, sequence, each, offset = (s[c][at].astype(np.int64) for c in ("rank", "sequence", "each", "offset"))
            within = rank - first
            sequence, offset = sequence + within // each, offset + within % each * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked, seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
