"""Substring dedup by recompression.

Words are compressed in rounds: runs of one word first, then pairs of neighbours
of which the left belongs to one half of the alphabet and the right to the other.
Names and halves come from hashes, so every task names the same run or pair alike
and equal substrings get equal symbols wherever their surroundings can't be seen.
Each symbol carries the words its existence depends on; inside a window it is
certain if the window holds all of them.

A window of k words is indexed by one certain symbol: of the highest round that
has any, the one with the least hash (without any, the window itself).  Equal
windows choose equal symbols, so the windows of a repeat meet under a shared
symbol, are verified there by their own hashes, and all but the first are marked.
A word goes if a marked window covers it.

Neighbouring windows share a symbol and travel together.  Symbols frequent in a
sample (a passage, a boilerplate line, a stop word) are hot: their windows travel
one by one under their own hash, after each task has kept the first of equal ones.
The sample decides how rows travel and never what is found.

Windows are compared by 112 bits (symbol and window), 128 for hot ones: chance
equality is below 1e-12 for a whole corpus.  Null texts have no words; a null
doc_id sorts before all others; equal windows at the same place of rows that
repeat a doc_id are all kept, and rows are told apart by doc_id and a digest of the text; other columns stay untouched; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordkernel as wk
from tessera.llm.frames import map_batches, settle
from tessera.llm.wordkernel import U64

ROUNDS = 3
NONE = np.iinfo(np.uint64).max
FAR = 1 << 40
#: One document in SAMPLE is looked at for hot symbols; at most 1 / HOT_SHARE symbols can be hot.
SAMPLE = 32
HOT_SHARE = 2e-5
HOT_LEAST = 40
#: Rows, and windows in them, that a task holds before it deals them out.
ROWS = 60_000
WINDOWS = 1 << 20
NULL_ID = -(1 << 63)


class Level:
    """Symbols of one round: names, word spans and the words they depend on."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.doc, self.low, self.high = name, doc, low, high


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reach of the symbol before and after each one; beyond a text's edge it is unknown."""
    same = np.zeros(len(level.name) + 1, bool)
    same[1:-1] = level.doc[1:] == level.doc[:-1]
    before, after = same[:-1], same[1:]
    low_b, high_b = np.where(before, np.roll(level.low, 1), -FAR), np.where(before, np.roll(level.high, 1), 0)
    low_a, high_a = np.where(after, np.roll(level.low, -1), FAR), np.where(after, np.roll(level.high, -1), FAR)
    return low_b, high_b, low_a, high_a


def runs(h: np.ndarray, doc: np.ndarray) -> Level:
    """Round 0: maximal runs of one word."""
    n = len(h)
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, n)).astype(U64)
    name = np.where(times > 1, wk.mix64(h[at] + times * U64(0xD1B54A32D192ED03)), h[at])
    end = np.append(at[1:], n)
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = doc[at[1:]] == doc[at[1:] - 1]
    # where a run ends is known only from the one word beside it; beyond a text's edge it is unknown
    return Level(name, doc[at], np.where(same[:-1], at - 1, -FAR), np.where(same[1:], end + 1, FAR))


def pairs(level: Level, salt: int) -> Level:
    """One round of pair compression."""
    left = (wk.mix64(level.name ^ U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(1)).astype(bool)
    n = len(level.name)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:] & (level.doc[1:] == level.doc[:-1])
    second = np.zeros(n, bool)
    second[1:] = joins[:-1]
    low_b, high_b, low_a, high_a = _neighbours(level)
    # a left symbol that stays alone depends on the next, a right one on the one before
    low = np.where(left, np.minimum(level.low, low_a), np.minimum(level.low, low_b))
    high = np.where(left, np.maximum(level.high, high_a), np.maximum(level.high, high_b))
    name = level.name.copy()
    at = np.flatnonzero(joins)
    name[at] = wk.mix64(level.name[at] * U64(0x9FB21C651E98DF25) + level.name[at + 1] + U64(salt))
    low[at], high[at] = np.minimum(level.low[at], level.low[at + 1]), np.maximum(level.high[at], level.high[at + 1])
    keep = ~second
    return Level(name[keep], level.doc[keep], low[keep], high[keep])


def anchors(h: np.ndarray, doc: np.ndarray, valid: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The symbol that indexes each window start; ``valid`` marks starts, ``own`` hashes windows."""
    n = len(h)
    levels = [runs(h, doc)]
    for r in range(1, ROUNDS + 1):
        levels.append(pairs(levels[-1], r))
    best = np.full(n, NONE, U64)
    for level in reversed(levels):
        open_ = valid & (best == NONE)
        missing = np.concatenate([[0], np.cumsum(open_)])
        if not missing[-1]:
            break
        first, last = np.maximum(level.high - k, 0), np.minimum(level.low, n - 1)
        ok = np.flatnonzero((level.high - level.low <= k) & (level.low >= 0) & (level.high <= n))
        ok = ok[missing[last[ok] + 1] > missing[first[ok]]]
        if not len(ok):
            continue
        width = last[ok] - first[ok] + 1
        where = np.repeat(first[ok], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        rank = np.repeat(wk.mix64(level.name[ok]) >> U64(1), width)
        use = open_[where]
        np.minimum.at(best, where[use], rank[use])
    alone = valid & (best == NONE)
    best[alone] = wk.mix64(own[alone] ^ U64(0x5851F42D4C957F2D)) >> U64(1)
    return best


class _Rows:
    """Rows of a slice: a symbol, its document, the first window and how many follow."""

    def __init__(self, column: pa.Array, doc_ids: np.ndarray, digests: np.ndarray, k: int):
        data, bounds = wk.text_bytes(column)
        words = wk.split_words(data, bounds)
        h, doc = wk.word_hashes(words), words.doc()
        starts, per = wk.windows_inside(words.first, k)
        self.window = np.zeros(len(h), U64)
        if not len(starts):
            self.name, self.doc, self.text, self.at, self.first, self.count = (np.zeros(0, t) for t in (U64, *[np.int64] * 5))
            return
        w = wk.window_hashes(h, k)
        self.window[: len(w)] = w
        valid = np.zeros(len(h), bool)
        valid[starts] = True
        chosen = anchors(h, doc, valid, self.window, k)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        new |= (np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))) % 255 == 0
        at = np.flatnonzero(new)
        self.name, self.count = chosen[at], np.diff(np.append(at, len(starts)))
        self.at = starts[at]  # in the slice
        self.first = self.at - words.first[doc[self.at]]  # in its document
        self.doc, self.text = doc_ids[doc[self.at]], digests[doc[self.at]]


def _expand(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _ranges(doc: np.ndarray, text: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked windows as word ranges of rows."""
    order = np.lexsort((p, text, doc))
    doc, text, p = doc[order], text[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (p[1:] > p[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(p)) - 1
    return doc[at], text[at], p[at], p[np.maximum(end, 0)] + k if len(at) else p[at]


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id")


def _digest() -> Column:
    return F.xxhash64("text").alias("_digest")


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(_id(), _digest(), "text")


def hot_symbols(docs: DataFrame, k: int) -> np.ndarray:
    """Symbols frequent in a sample; fewer than 1 / HOT_SHARE whatever the corpus."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in wk.slices(batch.column("text"), 1 << 19):
                rows = _Rows(batch.column("text")[i:j], np.arange(j - i), np.zeros(j - i, np.int64), k)
                name, n = np.unique(rows.name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n)], names=["name", "n"])

    some = _key(docs).filter(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = settle(map_batches(some, names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= max(HOT_LEAST, total * HOT_SHARE)).select("name").toArrow()["name"].to_numpy()
    return np.sort(found.view(U64))


def _packed(docs: DataFrame, hot: np.ndarray, parts: int, k: int) -> DataFrame:
    """(part, kind, blob): windows dealt by symbol, kind 0; ranges marked already, kind 1."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, size, wide = shared.value, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, wide
            name, doc, text, p, count, window = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size, wide = [], 0, 0
            at = np.cumsum(count) - count
            marked = (np.zeros(0, np.int64),) * 3
            if len(hot):
                i = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
                is_hot = hot[i] == name
                if is_hot.any():
                    c = count[is_hot]
                    w = window[_expand(at[is_hot], c)]
                    d, x, q = np.repeat(doc[is_hot], c), np.repeat(text[is_hot], c), _expand(p[is_hot], c)
                    order = np.lexsort((x, q, d, w))
                    w, d, x, q = w[order], d[order], x[order], q[order]
                    lead = np.ones(len(w), bool)
                    lead[1:] = w[1:] != w[:-1]
                    least = np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))
                    later = (d != d[least]) | (q != q[least])
                    marked = (d[later], x[later], q[later])
                    # rows of one doc_id that differ elsewhere may share the first place
                    lead[1:] |= ~later[1:] & (x[1:] != x[:-1])
                    cold = ~is_hot
                    window = np.concatenate([window[_expand(at[cold], count[cold])], w[lead]])
                    name = np.concatenate([name[cold], wk.mix64(w[lead] ^ U64(0x14057B7EF767814F))])
                    doc, text, p = np.concatenate([doc[cold], d[lead]]), np.concatenate([text[cold], x[lead]]), np.concatenate([p[cold], q[lead]])
                    count = np.concatenate([count[cold], np.ones(int(lead.sum()), np.int64)])
                    at = np.cumsum(count) - count
            dest = (name % U64(parts)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            edge = np.searchsorted(dest[order], np.arange(parts + 1))
            part, kind, blobs = [], [], []
            for d in range(parts):
                own = order[edge[d] : edge[d + 1]]
                if len(own):
                    w = window[_expand(at[own], count[own])]
                    blobs.append(b"".join([np.int64(len(own)).tobytes(), name[own].tobytes(), doc[own].tobytes(), text[own].tobytes(), p[own].astype(np.int32).tobytes(), count[own].astype(np.uint8).tobytes(), w.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()]))
                    part.append(d)
                    kind.append(0)
            if len(marked[0]):
                d, x, a, b = _ranges(*marked, k)
                blobs.append(np.stack([d, x, a, b]).astype(np.int64).tobytes())
                part.append(int(d[0] % parts))
                kind.append(1)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

        for batch in batches:
            ids, digests = (batch.column(c).to_numpy() for c in ("_id", "_digest"))
            for i, j in wk.slices(batch.column("text"), 1 << 19):
                rows = _Rows(batch.column("text")[i:j], ids[i:j], digests[i:j], k)
                if len(rows.name):
                    held.append((rows.name, rows.doc, rows.text, rows.first, rows.count, rows.window[_expand(rows.at, rows.count)]))
                    size += len(rows.name)
                    wide += int(rows.count.sum())
                if size >= ROWS or wide >= WINDOWS:
                    yield flush()
        if held:
            yield flush()

    return map_batches(_key(docs), run, "part int, kind int, blob binary")


def _repeats(k: int):
    """Of one partition's windows, all but the first of equal ones, as word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(d: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(d), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (d, t, a, b)], names=["_id", "_digest", "start", "stop"])

        names, docs, texts, ps, counts, windows = [], [], [], [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                raw = np.frombuffer(blob.as_buffer(), np.uint8)
                if kind == 1:
                    yield from out(*raw.view(np.int64).reshape(4, -1))
                    continue
                m = int(raw[:8].view(np.int64)[0])
                names.append(raw[8 : 8 + 8 * m].view(U64).copy())
                docs.append(raw[8 + 8 * m : 8 + 16 * m].view(np.int64).copy())
                texts.append(raw[8 + 16 * m : 8 + 24 * m].view(np.int64).copy())
                ps.append(raw[8 + 24 * m : 8 + 28 * m].view(np.int32).astype(np.int64))
                counts.append(raw[8 + 28 * m : 8 + 29 * m].astype(np.int64))
                windows.append(raw[8 + 29 * m :].reshape(-1, 6).copy())
        if not names:
            return
        name, doc, text, p, count = (np.concatenate(x) for x in (names, docs, texts, ps, counts))
        window = np.concatenate(windows)
        del names, docs, texts, ps, counts, windows
        at = np.cumsum(count) - count
        order = np.argsort(name, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        group = np.zeros(len(name), np.int64)
        group[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(name))))
        # a symbol met once indexes no repeat, unless its own windows repeat (a run of words)
        busy = np.bincount(group)[group] > 1
        busy |= count > k
        several = np.flatnonzero(~busy & (count > 1))
        if len(several):
            # a row may start before its repeating part, so all its windows are compared, at most k of them
            c = count[several]
            wide = np.zeros((int(c.sum()), 8), np.uint8)
            wide[:, :6] = window[_expand(at[several], c)]
            w, own = wide.view(U64).ravel(), np.repeat(several, c)
            for d in range(1, int(c.max())):
                busy[own[d:][(w[d:] == w[:-d]) & (own[d:] == own[:-d])]] = True
            del wide, w, own
        rows = np.flatnonzero(busy)
        if not len(rows):
            return
        c = count[rows]
        wide = np.zeros((int(c.sum()), 8), np.uint8)
        wide[:, :6] = window[_expand(at[rows], c)]
        w, g = wide.view(U64).ravel(), np.repeat(group[rows], c)
        d, x, q = np.repeat(doc[rows], c), np.repeat(text[rows], c), _expand(p[rows], c)
        order = np.lexsort((q, d, w, g))
        w, g, d, x, q = w[order], g[order], d[order], x[order], q[order]
        lead = np.ones(len(w), bool)
        lead[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        least = np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))
        later = (d != d[least]) | (q != q[least])
        if later.any():
            yield from out(*_ranges(d[later], x[later], q[later], k))

    return run


def _kept(tidy: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that marked ranges cover."""
    for batch in batches:
        columns = [batch.column(c) for c in ("_row", "_id", "text", "ranges")]
        for i, j in wk.slices(columns[2], 1 << 19):
            _, ids, texts, ranges = (c[i:j] for c in columns)
            data, bounds = wk.text_bytes(texts)
            words = wk.split_words(data, bounds)
            m = len(words)
            step = np.zeros(m + 1, np.int64)
            lengths = np.array([len(r) if r.is_valid else 0 for r in ranges], np.int64)
            if lengths.any():
                flat = ranges.flatten()
                base = np.repeat(words.first[:-1], lengths)
                np.add.at(step, base + flat.field("start").to_numpy(), 1)
                np.add.at(step, base + flat.field("stop").to_numpy(), -1)
            gone = np.cumsum(step[:-1]) > 0
            stay = np.flatnonzero(~gone)
            doc = words.doc()[stay]
            more = np.zeros(len(stay), bool)  # another kept word of the same text follows
            more[:-1] = doc[1:] == doc[:-1]
            mark = np.zeros(len(data) + 2, np.int8)
            np.add.at(mark, words.starts[stay], 1)
            np.add.at(mark, words.ends[stay] + more, -1)
            mask = np.cumsum(mark[: len(data)], dtype=np.int8) > 0
            n_removed = np.bincount(words.doc()[gone], minlength=j - i) if m else np.zeros(j - i, np.int64)
            text = data.copy()
            text[words.ends[stay][more]] = 0x20
            if not tidy:
                whole = np.repeat(n_removed == 0, np.diff(bounds))
                mask |= whole
                text[whole] = data[whole]
            out = text[mask].tobytes()
            cut = np.concatenate([[0], np.cumsum(mask)])[bounds]
            kept = pa.StringArray.from_buffers(j - i, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([columns[0][i:j], pa.array(words.counts), pa.array(n_removed), kept], names=["_row", "n_words", "n_removed", "kept"])


def repeated(docs: DataFrame, k: int = 20) -> DataFrame:
    """_id, _digest, start, stop: word ranges whose windows also start earlier."""
    # a task holds all windows of its partition, so there are more partitions than usual
    parts = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(docs, hot_symbols(docs, k), parts, k)
    return map_batches(packed.repartition(parts, "part").select("kind", "blob"), _repeats(k), "_id long, _digest long, start long, stop long")


def dedup(docs: DataFrame, k: int = 20, tidy: bool = True) -> DataFrame:
    """The rows of docs, but for the text, with n_words, n_removed and kept, the text without its repeats.

    Kept words are joined by one space; without ``tidy``, only in texts that lose some.
    Columns of docs that have those three names are replaced.
    """
    ranges = settle(repeated(docs, k)).groupBy("_id", "_digest").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    named = [f"`{c}`" for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept")]
    rows = docs.select(F.struct(*named).alias("_row"), _id(), _digest(), "text").join(ranges, ["_id", "_digest"], "left")
    row_type = rows.schema["_row"].dataType.simpleString()
    kept = map_batches(rows, functools.partial(_kept, tidy), f"_row {row_type}, n_words long, n_removed long, kept string")
    return kept.select("_row.*", "n_words", "n_removed", "kept")
