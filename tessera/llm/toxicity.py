"""Toxicity by compression distance.

Labelled toxic texts and labelled ordinary texts are dealt into ``SHARDS`` parts
by a hash of doc_id, and each part gives a separate zstandard dictionary: the words
of its whole texts, each once, in the order in which they first occur.  Before that
every word, a run of letters without regard to case, becomes a code of ``WIDTH``
hashes, so a match is a whole word and never a syllable that toxic and ordinary
words share.

A window is one word (wider ones let the words that only ordinary text has cancel
the toxic ones; figures in the README).  It is compressed with every dictionary:
where the toxic dictionary of a part shortens it by half a code more than the
ordinary one, the part votes for it, and against it the other way.  A word that
toxic texts share has votes from most parts, one that happens to stand in a single
text has one.  Votes beyond the first, over all words of a document and for each of
them, are its distance; a logistic fit turns that into a score.

A document never meets the dictionaries of its own part, so what the calibration
sees of learnt rows is what it would see of others.

The dictionaries are trained on at most ``TOXIC`` toxic and ``ORDINARY`` other
labelled documents, those with the smallest hashes of doc_id, each whole; the
calibration uses every labelled row that may be learnt from.  Every word of every
text is compared.

Null and empty texts have no votes and get the lowest score.  Without toxic or
without ordinary rows to learn from every score is 0.  Null labels are not
learnt from; a row labelled twice counts twice in the calibration and rows that
repeat a doc_id are scored each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordkernel as wk
from tessera.llm.frames import map_batches, settle
from tessera.llm.unit_encoder import lower_bytes

TOXIC, ORDINARY = 800, 6400
SHARDS = 8
#: Hashes in the code of a word.
WIDTH = 3
SMOOTH = 30
STEEP = 1000.0
BINS = 400
#: Words whose votes a task remembers.
KNOWN = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the first word of each text."""
    data, bounds = wk.text_bytes(column)
    low = lower_bytes(data)
    low[~_LETTER[low]] = 0x20
    words = wk.split_words(low, bounds)
    return wk.word_hashes(words).astype("<u8"), words.first


def once(codes: np.ndarray) -> np.ndarray:
    """Distinct codes in the order of their first occurrence."""
    return codes[np.sort(np.unique(codes, return_index=True)[1])]


def spelled(codes: np.ndarray) -> bytes:
    """Codes at their full width."""
    return np.column_stack([codes, *(wk.mix64(codes ^ wk.U64(i * 0xA24BAED4963EE407 & (1 << 64) - 1)) for i in range(1, WIDTH))]).astype("<u8").tobytes()


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=24, hash_log=20, chain_log=16, search_log=1, min_match=7, target_length=0, strategy=zstandard.STRATEGY_FAST,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content or bytes(8 * WIDTH), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def train(sample: list[tuple[int, int, bytes]]) -> list[tuple[bytes, bytes]] | None:
    """Contents of the ordinary and the toxic dictionary of each part, from (part, label, word hashes of a text)."""
    if len({y for _, y, _ in sample}) < 2:
        return None
    held: dict[tuple[int, int], list[bytes]] = {}
    for part, y, words in sample:
        held.setdefault((part, y), []).append(words)
    content = lambda i, y: spelled(once(np.frombuffer(b"".join(held.get((i, y), [])), "<u8")))
    return [(content(i, 0), content(i, 1)) for i in range(SHARDS)]


class Votes:
    """Votes of the parts on words; those of words met before are remembered."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]):
        self.pairs = [(compressor(o), compressor(t)) for o, t in dictionaries]
        self.codes, self.votes = np.zeros(0, "<u8"), np.zeros((0, SHARDS), np.int8)

    @staticmethod
    def _lengths(c: zstandard.ZstdCompressor, raw: bytes, spans: bytes) -> np.ndarray:
        out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, spans), threads=0)
        return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))

    def _measure(self, codes: np.ndarray) -> np.ndarray:
        raw, size = spelled(codes), 8 * WIDTH
        spans = np.column_stack([np.arange(len(codes)) * size, np.full(len(codes), size)]).astype(np.uint64).tobytes()
        out = np.empty((len(codes), SHARDS), np.int8)
        for i, (ordinary, toxic) in enumerate(self.pairs):
            saved = self._lengths(ordinary, raw, spans) - self._lengths(toxic, raw, spans)
            out[:, i] = (saved >= size // 2).astype(np.int8) - (saved <= -size // 2)
        return out

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Rows of votes for ascending distinct codes."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        new = self.codes[at] != codes if len(self.codes) else np.ones(len(codes), bool)
        if new.any():
            if len(self.codes) + int(new.sum()) > KNOWN:
                self.codes, self.votes, new = np.zeros(0, "<u8"), np.zeros((0, SHARDS), np.int8), np.ones(len(codes), bool)
            every = np.concatenate([self.codes, codes[new]])
            votes = np.concatenate([self.votes, self._measure(codes[new])])
            order = np.argsort(every, kind="stable")
            self.codes, self.votes = every[order], votes[order]
            at = np.searchsorted(self.codes, codes)
        return self.votes[at]


_made: dict[int, Votes] = {}


def votes_of(dictionaries: list[tuple[bytes, bytes]]) -> Votes:
    """One for all tasks of a worker process."""
    key = xxhash.xxh3_64_intdigest(b"".join(x for pair in dictionaries for x in pair))
    if key not in _made:
        _made.clear()
        _made[key] = Votes(dictionaries)
    return _made[key]


def distances(column: pa.Array, part: np.ndarray, votes: Votes) -> np.ndarray:
    """Votes beyond the first for each word of each text, from the parts that are not its own."""
    codes, first = coded(column)
    number = np.diff(first)
    doc = np.repeat(np.arange(len(number)), number)
    distinct, word = np.unique(codes, return_inverse=True)
    table = votes(distinct).astype(np.int64)
    total = table.sum(1)[word] - table[word, part[doc]]
    return np.bincount(doc, np.maximum(total - 1, 0), minlength=len(number)) / (SHARDS - 1) / (number + SMOOTH)


def _part(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SHARDS)).cast("int")


def measured(docs: DataFrame, dictionaries: list[tuple[bytes, bytes]] | None) -> DataFrame:
    """doc_id, distance from every word of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # the words of TOXIC + ORDINARY documents at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = votes_of(shared.value) if shared.value else None
        for batch in batches:
            texts, part = batch.column("text"), batch.column("part").to_numpy()
            for i, j in wk.slices(texts, 1 << 20):
                value = distances(texts[i:j], part[i:j], votes) if votes else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(value)], names=["doc_id", "distance"])

    doc_id = F.col("doc_id").cast("long")
    return map_batches(docs.select(doc_id.alias("doc_id"), _part(doc_id).alias("part"), "text"), run, "doc_id long, distance double")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, y, words: the distinct words of each whole text."""
    for batch in batches:
        for i, j in wk.slices(batch.column("text"), 1 << 20):
            codes, first = coded(batch.column("text")[i:j])
            blobs = [once(codes[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("part")[i:j], batch.column("y")[i:j], pa.array(blobs, pa.binary())], names=["doc_id", "part", "y", "words"])


def logistic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Slope and intercept fitted to binned counts by Newton's method, slightly shrunk."""
    scale = max(float(np.average(x, weights=total)), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (positive - total * p) - 1e-3 * w
        hessian = (z * (total * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0) / scale, float(w[1])


def classify(docs: DataFrame, labels: DataFrame, learnt: Column, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every document; learns only where ``learnt`` holds of doc_id."""
    known = settle(labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(learnt))
    some = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(n)
    picked = F.broadcast(some(1, TOXIC).unionByName(some(0, ORDINARY)))  # TOXIC + ORDINARY rows at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").withColumn("part", _part(F.col("doc_id")))
    found = map_batches(sample.select("doc_id", "part", "y", "text"), _words, "doc_id long, part int, y int, words binary").collect()
    dictionaries = train([(r["part"], r["y"], bytes(r["words"])) for r in sorted(found)])
    table = settle(measured(docs, dictionaries))
    top = float(np.log1p(STEEP))
    bent = F.least(F.log1p(F.col("distance") * STEEP), F.lit(top))
    slot = F.least(F.floor(bent * (BINS / top)), F.lit(BINS - 1)).alias("bin")
    bins = table.join(known, "doc_id").groupBy(slot).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect() if dictionaries else []
    if bins:
        slope, level = logistic(*(np.array(v, float) for v in zip(*((r["bin"] * top / BINS, r["y"], r["n"]) for r in bins), strict=True)))
        score = 1 / (1 + F.exp(-(bent * slope + level)))
    else:
        score = F.lit(0.0)
    return table.select("doc_id", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
