"""N-gram Jaccard join as an exact join in the Jaccard metric space.

Distance is 1 - |x & y| / |x | y| over sets of word shingles; documents link
within radius r = 1 - similarity.  The join descends through two kinds of pivots.

*Singleton pivots.*  Among the one-shingle sets the nearest pivots of a document
are its own shingles.  Leaving a shingle behind moves a document 1/|x| away, so
inside radius r only a bounded window of shingles can be left behind: a document
is replicated to the first (1 - s)|x| + l shingles of a global order, and a linked
pair must share l of those.  Shingles that no other document has can't be shared
and go; a document that keeps fewer than its partners need goes; of the rest, only
the rarest are needed, which keeps passages that many documents share out.

*Document pivots.*  Each surviving shingle names the least document that has it.
That document is the pivot of a Voronoi region, and the documents whose windows
name it, boundary documents included, are replicated there.  A region of more than
``LEAF`` documents is split by pivots of its own: a document goes to the region of
its nearest pivot, its home, and by the triangle inequality to every region whose
pivot is at most 2r farther.  A split is kept where it leaves at most ``WORTH`` of the
region's pairs, and the parts are split again, ``DEPTH`` times in all; a ball narrower
than r can't be split by any pivot and stays whole, in tiles of ``TILE`` documents.
Nothing is capped.

*Certain links.*  In a whole region of more than ``LEAF`` documents the member with the
greatest total overlap with a few others is the pivot of a core: documents within r/2
of it are, by the triangle inequality, all linked with each other, and their pairs are
counted without being looked at.  All other intersections are counted by matrix products
over the shingles the region shares; a pair belongs to one region only, so links are
counted once.  Documents
with equal sets are one point with a weight.  Sets are told apart by 64-bit digests
and shingles by 64-bit hashes: a pair is misjudged with a probability near 1e-13.

Null texts and texts without words have no shingles and link with nothing; shorter
texts are one shingle; a row whose doc_id is null is reported with its own set but
lends no id to a component; rows that repeat a doc_id count one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import wordkernel as wk
from tessera.llm.components import components
from tessera.llm.frames import columns, fresh, map_batches, settle
from tessera.llm.wordkernel import U64

LEAF = 16
DEPTH = 2
PIVOTS = 8
DRAWN = 64
#: The share of a region's pairs that a split may leave.
WORTH = 0.7
#: Documents of a region that no pivot splits, beyond which it is tiled.
TILE = 1000
#: A shingle this frequent among the documents of one chunk is hot everywhere.
HOT = 64
CHUNK = 1_000_000
#: Sets one task remembers, to send a repeated one once.
SEEN = 1_000_000
HOT_ORDER = 1 << 30


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all texts, and the bounds of each text."""
    data, bounds = wk.text_bytes(column)
    words = wk.split_words(data, bounds)
    h = wk.word_hashes(words, lower=True)
    n = len(bounds) - 1
    at, per = wk.windows_inside(words.first, width)
    s = wk.window_hashes(h, width)[at] if len(at) else np.zeros(0, U64)
    doc = np.repeat(np.arange(n), per)
    few = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(few):
        own = np.array([wk.window_hashes(h[words.first[d] : words.first[d + 1]], int(words.counts[d]))[0] for d in few], U64)
        s, doc = np.concatenate([s, own]), np.concatenate([doc, few])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)


def _least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest intersection a set of n shingles can have with a partner."""
    return -(-percent * n // 100)


def _extra(n: np.ndarray | int) -> np.ndarray | int:
    return n // 10 + 1


def points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, k (digest of the set, null without one), window (its first shingles, once per task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j in wk.slices(batch.column("text"), 1 << 20):
                s, first = shingle_sets(batch.column("text")[i:j], width)
                n = np.diff(first)
                k = wk.fold_rows(s, first).view(np.int64)
                window = np.minimum(n, n - _least_overlap(n, percent) + _extra(n))
                raw = s.tobytes()
                blobs = []
                for a, w, key in zip(first[:-1].tolist(), window.tolist(), k.tolist(), strict=True):
                    new = w and key not in seen
                    if new and len(seen) < SEEN:
                        seen.add(key)
                    blobs.append(raw[8 * a : 8 * (a + w)] if new else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(n), pa.array(k, mask=n == 0), pa.array(blobs, pa.binary())], names=["doc_id", "n", "k", "window"])

    return settle(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, k long, window binary"))


def _spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, state, part): state 0 is a row, HOT_ORDER a row of a hot shingle, -1 a sign that h is hot."""
    names = ["h", "k", "state", "part"]

    def out(hs: list[np.ndarray], ks: list[np.ndarray]) -> pa.RecordBatch:
        h, k = np.concatenate(hs), np.concatenate(ks)
        order = np.argsort(h, kind="stable")
        h, k = h[order], k[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        run = np.diff(np.append(edge, len(h)))
        hot = np.repeat(run >= HOT, run)
        signs = h[edge[run >= HOT]]
        state = np.where(hot, HOT_ORDER, 0).astype(np.int32)
        part = np.where(hot, k, h)  # rows of a hot shingle are dealt by document
        cols = [np.concatenate([h, signs]), np.concatenate([k, np.zeros(len(signs), np.int64)]), np.concatenate([state, np.full(len(signs), -1, np.int32)]), np.concatenate([part, signs])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    hs, ks, size = [], [], 0
    for batch in batches:
        for k, blob in zip(batch.column("k").to_pylist(), batch.column("window"), strict=True):
            h = np.frombuffer(blob.as_buffer(), np.int64)
            hs.append(h)
            ks.append(np.full(len(h), k))
            size += len(h)
            if size >= CHUNK:
                yield out(hs, ks)
                hs, ks, size = [], [], 0
    if hs:
        yield out(hs, ks)


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, often) of shingles that two documents have; a partition holds all rows of an h that isn't hot."""
    parts = [[batch.column(c).to_numpy() for c in ("h", "k", "state")] for batch in batches]
    if not parts:
        return
    h, k, state = (np.concatenate(p) for p in zip(*parts, strict=True))
    signs = np.unique(h[state == -1])
    rows = state == 0
    passed = state == HOT_ORDER
    hot_h, hot_k = h[passed], k[passed]
    h, k = h[rows], k[rows]
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[new], k[new]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        run = np.repeat(np.diff(np.append(edge, len(h))), np.diff(np.append(edge, len(h))))
        if len(signs):
            at = np.minimum(np.searchsorted(signs, h), len(signs) - 1)
            run = np.where(signs[at] == h, HOT_ORDER, run)
        keep = run >= 2
        h, k, run = h[keep], k[keep], run[keep]
    else:
        run = np.zeros(0, np.int64)
    h, k, run = np.concatenate([h, hot_h]), np.concatenate([k, hot_k]), np.concatenate([run, np.full(len(hot_h), HOT_ORDER)])
    for i in range(0, len(h), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000]), pa.array(k[i : i + 200_000]), pa.array(run[i : i + 200_000].astype(np.int32))], names=["h", "k", "often"])


def regions(table: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(p, k): documents and the pivots whose regions they are in."""
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = map_batches(table.filter("window is not null").select("k", "window"), _spread_windows, "h long, k long, state int, part long")
    shared = map_batches(rows.repartition(parts, "part").drop("part"), _shared_only, "h long, k long, often int")
    each = shared.distinct().groupBy("k").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("list"))
    n, c = F.col("n"), F.size("list")
    smallest = F.ceil(n * percent / 100).cast("long")  # a partner has at least as many shingles
    need = (F.floor(smallest / 10) + 1).cast("int")
    kept = each.join(classes.select("k", "n"), "k").filter(c >= need).select("k", F.explode(F.slice("list", F.lit(1), c - need + 1)).alias("e")).select("k", F.col("e.h").alias("h"))
    kept = settle(kept)
    lead = kept.groupBy("h").agg(F.min("k").alias("p"), F.count("*").alias("of")).filter("of > 1").select("h", "p")
    return settle(kept.join(lead, "h").select("p", "k").distinct())


def members(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """k, shingles (binary) of one document of each chosen class (k, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in wk.slices(batch.column("text"), 1 << 20):
                s, first = shingle_sets(batch.column("text")[i:j], width)
                raw = s.tobytes()
                own = wk.fold_rows(s, first).view(np.int64)
                asked = batch.column("k")[i:j]
                ok = own == asked.fill_null(0).to_numpy()  # a doc_id may have several rows
                ok = np.flatnonzero((ok | ~np.asarray(asked.is_valid())) & (np.diff(first) > 0))
                blobs = [raw[8 * first[d] : 8 * first[d + 1]] for d in ok.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(blobs, pa.binary())], names=["k", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(chosen.filter("doc_id is not null").hint("shuffle_hash"), "doc_id").select("k", "text")
    # classes without any id: the digests of rows without one tell whether they are wanted
    lost = rows.filter("doc_id is null").select(F.lit(None).cast("long").alias("k"), "text")
    known = map_batches(texts, run, "k long, shingles binary")
    found = map_batches(lost, run, "k long, shingles binary").join(chosen.filter("doc_id is null").select("k"), "k", "left_semi")
    return settle(known.unionByName(found).dropDuplicates(["k"]))


def _overlaps(sets: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Intersection sizes of sets (or those in ``rows``) with all sets, by products over the shingles they share."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((len(sets) if rows is None else len(rows), len(sets)), np.float32)
    if len(column):
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step = max(64, min(4096, (1 << 23) // len(sets)))
        for a in range(0, int(column[-1]) + 1, step):
            lo, hi = np.searchsorted(column, (a, a + step))
            m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - a)), np.float32)
            m[owner[lo:hi], column[lo:hi] - a] = 1
            total += (m if rows is None else m[rows]) @ m.T
    # a set shares all of itself with itself, shingles that no other has included
    total[np.arange(len(total)), np.arange(len(sets)) if rows is None else rows] = n if rows is None else n[rows]
    return total


LINK_SCHEMA = "k long, root long, links long"


def _core(sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Members that the triangle inequality links with each other: those within r/2 of one pivot."""
    tried = [_common(s, sets) for s in sets[:PIVOTS]]
    both = max(tried, key=lambda b: int(b.sum()))
    size = n[int(np.argmax([b.sum() for b in tried]))]
    # 1 - both / union <= r / 2, in integers
    return 200 * both >= (100 + percent) * (n + size - both)


def _common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of an ascending set with each of others."""
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.bincount(np.repeat(np.arange(len(sets)), n), hit, len(sets)).astype(np.int64)


#: Rows of a region's matrix looked at together where numbers are wider than a byte.
STRIPE = 256


def _linked(sets: list[np.ndarray], percent: int, leaf: int) -> np.ndarray:
    """Which members link; pairs inside a core are known without their intersection."""
    n = np.array([len(s) for s in sets])
    core = _core(sets, n, percent) if len(sets) > leaf else np.zeros(len(sets), bool)
    rest = np.flatnonzero(~core) if core.sum() > 1 else np.arange(len(sets))
    out = np.zeros((len(sets), len(sets)), bool)
    if core.sum() > 1:
        inside = np.flatnonzero(core)
        out[np.ix_(inside, inside)] = True
    if len(rest):
        both = _overlaps(sets, None if len(rest) == len(sets) else rest)
        for i in range(0, len(rest), STRIPE):
            own = rest[i : i + STRIPE]
            part = both[i : i + STRIPE].astype(np.float64)
            hit = 100 * part >= percent * (n[own][:, None] + n[None, :] - part)
            out[own] = hit
            out[:, own] = hit.T
    return out


def _join_region(percent: int, leaf: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        sets = [np.frombuffer(b, np.int64) for b in pdf["shingles"]]
        k, weight = pdf["k"].to_numpy(), pdf["weight"].to_numpy()
        linked = _linked(sets, percent, leaf)
        np.fill_diagonal(linked, False)
        # components inside the region
        size = len(k)
        label = np.arange(size, dtype=np.int32)
        while True:
            new = label.copy()
            for i in range(0, size, STRIPE):
                new[i : i + STRIPE] = np.minimum(label[i : i + STRIPE], np.where(linked[i : i + STRIPE], label[None, :], size).min(1, initial=size))
            new = new[new]
            if (new == label).all():
                break
            label = new
        # a pair is counted in one cell: of its least common pivot, at each level of its least home, in its tile
        own = linked
        for level, low in enumerate(pdf["lows"].iloc[0]):
            home = np.array([h[level] for h in pdf["homes"]])
            least, there = home == low, home >= low
            own &= least[:, None] | least[None, :]
            own &= there[:, None] & there[None, :]
        block = pdf["block"].to_numpy()
        one, other = block == pdf["a"].iloc[0], block == pdf["b"].iloc[0]
        own &= (one[:, None] & other[None, :]) | (other[:, None] & one[None, :])
        region = pdf["p"].iloc[0]
        lists = pdf["pivots"].tolist()
        earlier = {q: i for i, q in enumerate(sorted({q for qs in lists for q in qs if q < region}))}
        if earlier:
            named = np.zeros((size, len(earlier)), np.float32)
            for i, qs in enumerate(lists):
                named[i, [earlier[q] for q in qs if q < region]] = 1
            for i in range(0, size, STRIPE):
                own[i : i + STRIPE] &= named[i : i + STRIPE] @ named.T == 0
        links = np.concatenate([own[i : i + STRIPE] @ weight for i in range(0, size, STRIPE)])
        return pd.DataFrame({"k": k, "root": k[label], "links": links})

    return run


def _distances(one: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    both = _common(one, pivots)
    return 1 - both / (len(one) + np.array([len(p) for p in pivots]) - both)


CELL = "p long, k long, lows array<int>, homes array<int>"


def _split(radius: float):
    """Members and their cell's pivots to sub-cells: home, and all that the triangle inequality allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lows, homes = [], [], []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.int64)
                d = _distances(own, [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column("around")[i].values])
                near = int(d.argmin())
                low, home = batch.column("lows")[i].as_py(), batch.column("homes")[i].as_py()
                for j in np.flatnonzero(d <= d[near] + 2 * radius + 1e-9).tolist():
                    row.append(i)
                    lows.append([*low, j])
                    homes.append([*home, near])
            kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("p", "k")]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lows, kind), pa.array(homes, kind)], names=["p", "k", "lows", "homes"])

    return run


def _cells(near: DataFrame, point: DataFrame, leaf: int, radius: float, tile: int = TILE) -> DataFrame:
    """Cells p, k, lows, homes, a, b, block: small ones, ones that no pivot splits, and tiles of those that are large."""
    none = F.array().cast("array<int>")
    cell = ["p", "lows"]
    open_ = near.select("p", "k", none.alias("lows"), none.alias("homes"))
    shingles, done = point.select("k", "shingles"), []
    whole = [F.lit(0).alias(c) for c in ("a", "b", "block")]

    def close(rows: DataFrame) -> None:
        """Rows of cells with their ``size``: whole if they fit a tile, otherwise tiles of two blocks, each pair of documents in one of them."""
        done.append(rows.filter(F.col("size") <= tile).select("p", "k", "lows", "homes", *whole))
        large = rows.filter(F.col("size") > tile)
        dealt = large.withColumn("n", F.ceil(F.col("size") * 2 / tile).cast("int")).withColumn("block", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        done.append(dealt.select("p", "k", "lows", "homes", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block"))

    for depth in range(DEPTH + 1):
        sizes = settle(open_.groupBy(*cell).agg(F.count("*").alias("size")))
        rows = open_.join(sizes, cell)
        large = rows.filter(F.col("size") > leaf)
        if depth == DEPTH or not sizes.filter(F.col("size") > leaf).limit(1).count():
            close(rows)
            break
        close(rows.filter(F.col("size") <= leaf))
        order = F.xxhash64("k", F.lit(depth))
        # pivots are drawn from about DRAWN members, however large the cell is
        mark = F.struct(order.alias("o"), "k")
        drawn = F.array_sort(F.collect_set(F.when(F.pmod(order, F.col("size")) < DRAWN, mark)))
        many = F.least(F.lit(PIVOTS), F.greatest(F.lit(2), F.floor(F.max("size") / 4))).cast("int")
        chosen = large.groupBy(*cell).agg(F.slice(F.array_union(drawn, F.array(F.min(mark))), F.lit(1), many).alias("c"))
        around = chosen.select(*cell, F.explode("c.k").alias("k")).join(shingles, "k").groupBy(*cell).agg(F.collect_list("shingles").alias("around"))
        split = settle(map_batches(large.join(shingles, "k").join(around, cell), _split(radius), CELL))
        # the pairs of all parts against those of the cell
        part = split.groupBy("p", "lows").agg(F.count("*").alias("n"))
        left = part.groupBy("p", F.slice("lows", 1, depth).alias("lows")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        kept = settle(sizes.join(left, cell).filter(F.col("pairs") <= F.col("size") * F.col("size") * WORTH).select(*cell))
        close(large.join(kept, cell, "left_anti"))
        above = kept.select("p", F.col("lows").alias("above"))
        open_ = split.withColumn("above", F.slice("lows", 1, depth)).join(above, ["p", "above"], "left_semi").select("p", "k", "lows", "homes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _solved(docs: DataFrame, width: int, percent: int, leaf: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n, k) and the classes of equal sets (k, n, doc_id, weight, root, links)."""
    table = points(docs, width, percent)
    classes = settle(table.filter("k is not null").groupBy("k").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")))
    near = regions(table, classes, percent)
    lists = near.groupBy("k").agg(F.collect_list("p").alias("pivots"))
    sets = members(docs, lists.select("k").join(classes.select("k", "doc_id"), "k"), width)
    point = settle(sets.join(lists, "k").join(classes.select("k", "weight"), "k"))
    full = _cells(near, point, leaf, 1 - percent / 100, tile).join(point, "k")
    found = settle(full.groupBy("p", "lows", "a", "b").applyInPandas(_join_region(percent, leaf), LINK_SCHEMA))
    roots = components(found.filter("k <> root").select(F.col("k").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    known = classes.join(roots.withColumnRenamed("u", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    return table, known.join(links, "k", "left")


def join(docs: DataFrame, width: int = 5, percent: int = 80, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document."""
    table, known = _solved(docs, width, percent, leaf, tile)
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = known.join(least, "root").select("k", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = table.select("doc_id", "n", "k").join(known, "k", "left")
    alone = F.col("k").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def one_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but one row only of each component.

    The row with the smallest doc_id stays (without any id, one of the least digest of its
    set; of several alike, any); rows that have no shingles all stay.  Where an id has
    several rows, or none, rows are told apart by their sets.
    """
    table, known = _solved(docs, width, percent, LEAF, TILE)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    best = known.groupBy("root").agg(F.min(first).alias("b")).select("b.doc_id", "b.k")
    rows = table.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("k").isNull()).alias("bare"))
    picked = rows.join(best.filter("doc_id is not null").select("doc_id", F.lit(True).alias("best")).distinct(), "doc_id", "left")
    picked = picked.filter("bare or best").select(F.col("doc_id").alias("_id"), (F.col("rows") == 1).alias("_sure"))
    id_, sure, key = (fresh(docs, c) for c in ("_id", "_sure", "_k"))
    own = docs.withColumn(id_, F.col("doc_id").cast("long"))
    named = own.filter(F.col(id_).isNotNull()).join(picked.toDF(id_, sure), id_)
    certain = named.filter(sure).select(*columns(docs))
    doubtful = named.filter(~F.col(sure)).select(id_, *columns(docs)).unionByName(own.filter(F.col(id_).isNull()).select(id_, *columns(docs)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in wk.slices(batch.column("text"), 1 << 20):
                s, at = shingle_sets(batch.column("text")[i:j], width)
                k = pa.array(wk.fold_rows(s, at).view(np.int64), mask=np.diff(at) == 0)
                yield pa.RecordBatch.from_arrays([batch.column("row")[i:j], batch.column("id")[i:j], k], names=["row", "id", "k"])

    tagged = doubtful.select(F.struct(*columns(docs)).alias("row"), F.col(id_).alias("id"), "text")
    kinds = StructType([tagged.schema["row"], StructField("id", LongType()), StructField("k", LongType())])
    told = map_batches(tagged, digest, kinds)
    bare = told.filter("k is null").select("row.*")
    kept = told.filter("k is not null").join(best.select(F.col("doc_id").alias("_d"), F.col("k").alias("_b")), (F.col("k") == F.col("_b")) & F.col("id").eqNullSafe(F.col("_d")), "left_semi")
    return certain.unionByName(bare).unionByName(kept.dropDuplicates(["k"]).select("row.*"))
