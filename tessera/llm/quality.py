"""Quality classifier: random Fourier features over document statistics.

Each whole text is reduced to ``STATS`` numbers.  Random cosines of the
standardised numbers approximate a Gaussian kernel; every partition sums its part
of the normal equations, the driver solves them as a ridge regression, and an
isotonic fit turns raw outputs into probabilities.  The equations are kept by
fold, so ridge strength and calibration are chosen on outputs of models that
have not seen the row.

Null and empty texts have the statistics of a text without words and get a
score like any other.  Without labelled rows every score is 0.5.  Labels that are
null are not learnt from; a document labelled twice counts twice; rows that repeat a
doc_id, or have none, are scored each by their own text; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordkernel as wk
from tessera.llm.frames import forget, map_batches, settle

FEATURES = 192
FOLDS = 4
BINS = 2000
#: Labelled rows whose equations one task sums at least, beyond sixteen tasks.
ROWS = 50_000
RIDGES = (1e-3, 1e-2, 1e-1, 1.0)
_SIGNS = ("|", "!", "#$%&*", ".", ",", "@/\\_", "<>{}[]=", "?;:'\"()-")


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[0x80:] = 4
    kind[wk.SPACE] = 5
    kind[ord("\n")] = 6
    for i, signs in enumerate(_SIGNS):
        for c in signs:
            kind[ord(c)] = 7 + i
    return kind


_CLASS = _classes()
_K = 7 + len(_SIGNS)
STATS = _K + 11


def _shares(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: distinct keys over keys, and the commonest key's share."""
    if not len(key):
        return np.ones(n), np.zeros(n)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(k)))
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    most = np.zeros(n)
    np.maximum.at(most, d[at], run)
    return np.where(np.bincount(doc, minlength=n) > 0, np.bincount(d[at], minlength=n) / total, 1.0), most / total


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS numbers for each text."""
    data, bounds = wk.text_bytes(column)
    n = len(bounds) - 1
    size = np.diff(bounds)
    doc_of = np.repeat(np.arange(n), size)
    counts = np.bincount(doc_of * _K + _CLASS[data], minlength=n * _K).reshape(n, _K)
    part = counts / np.maximum(size, 1)[:, None]
    words = wk.split_words(data, bounds)
    h, doc, number = wk.word_hashes(words), words.doc(), words.counts
    width = (words.ends - words.starts).astype(float)
    some = np.maximum(number, 1)
    mean = np.bincount(doc, width, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, width**2, n) / some - mean**2, 0))
    distinct, top = _shares(h, doc, n)
    at, per = wk.windows_inside(words.first, 3)
    fresh, _ = _shares(wk.window_hashes(h, 3)[at] if len(at) else at.astype(np.uint64), np.repeat(np.arange(n), per), n)
    upper = np.bincount(doc, (_CLASS[data[words.starts]] == 2).astype(float), n) / some if len(words) else np.zeros(n)
    ending = np.bincount(doc, (_CLASS[data[words.ends - 1]] >= 7).astype(float), n) / some if len(words) else np.zeros(n)
    short = np.bincount(doc, (width <= 2).astype(float), n) / some
    long_ = np.bincount(doc, (width > 12).astype(float), n) / some
    lines = (counts[:, 6] + 1) / (number + 1)
    return np.column_stack([part, np.log1p(number), np.log1p(mean), np.log1p(spread), distinct, top, fresh, upper, ending, short, long_, lines])


def described(docs: DataFrame) -> DataFrame:
    """doc_id and s (array of STATS doubles), from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in wk.slices(texts, 1 << 20):
                m = statistics(texts[i:j])
                s = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, STATS, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], s], names=["doc_id", "s"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, s array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATS)


class Basis:
    """Standardisation and random cosines, fixed by a seed."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.normal(size=(STATS, features)) / np.sqrt(STATS) * 0.7
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        x = np.clip((s - self.mean) / self.deviation, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.turn + self.phase)
        return np.column_stack([np.ones(len(s)), z])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots of an increasing piecewise-linear map."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


class Model:
    def __init__(self, basis: Basis | None, weights: np.ndarray | None = None, knots: tuple | None = None):
        self.basis, self.weights, self.knots = basis, weights, knots

    def score(self, s: np.ndarray) -> np.ndarray:
        if self.basis is None or self.knots is None:
            return np.full(len(s), 0.5)
        return np.clip(np.interp(self.basis(s) @ self.weights, *self.knots), 0.0, 1.0)


def _solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    # a[0, 0] counts rows: the strength grows with them only as a square root
    penalty = np.full(len(b), ridge * np.sqrt(max(a[0, 0], 1.0)))
    penalty[0] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def fit(stats: DataFrame, target: str) -> Model:
    """Fit on the rows of stats (s, and a 0/1 column named by target).

    The driver gathers sums only: 2 STATS numbers, FOLDS x FEATURES^2 numbers and
    BINS counts, whatever the number of rows.
    """
    rows = stats.select("s", F.col(target).cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(STATS), np.zeros(STATS)
        for batch in batches:
            m = _rows(batch.column("s"))
            n, one, two = n + len(m), one + m.sum(0), two + (m * m).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * STATS + 1)), pa.array(np.concatenate([one, two, [n]]))], names=["cell", "v"])

    sums = {r["cell"]: r["v"] for r in map_batches(rows, moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    n = sums.get(2 * STATS, 0)
    if not n:
        return Model(None)
    mean = np.array([sums[i] for i in range(STATS)]) / n
    square = np.array([sums[STATS + i] for i in range(STATS)]) / n
    basis = Basis(mean, np.sqrt(np.maximum(square - mean**2, 0)))
    dim = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, dim + 1, dim + 1))
        for batch in batches:
            y, fold, m = batch.column("y").to_numpy(), batch.column("fold").to_numpy(), _rows(batch.column("s"))
            for f in range(FOLDS):
                for i in range(0, len(m), 4096):
                    own = fold[i : i + 4096] == f
                    z = np.column_stack([basis(m[i : i + 4096][own]), y[i : i + 4096][own]])
                    total[f] += z.T @ z
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "v"])

    total = np.zeros(FOLDS * (dim + 1) ** 2)
    # a partition's sums take FOLDS x FEATURES^2 numbers, so partitions are as few as the rows are worth
    cells = map_batches(rows.coalesce(max(16, int(n) // ROWS)), equations, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    total = total.reshape(FOLDS, dim + 1, dim + 1)
    whole = total.sum(0)

    def missed(ridge: float) -> tuple[float, list[np.ndarray]]:
        error, each = 0.0, []
        for f in range(FOLDS):
            rest = whole - total[f]
            w = _solve(rest[:-1, :-1], rest[:-1, -1], ridge)
            each.append(w)
            own = total[f]
            error += own[-1, -1] - 2 * w @ own[:-1, -1] + w @ own[:-1, :-1] @ w
        return error, each

    ridge = min((missed(r)[0], r) for r in RIDGES)[1]
    each = np.array(missed(ridge)[1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = basis(_rows(batch.column("s")))
            raw = (z * each[batch.column("fold").to_numpy()]).sum(1)
            at = np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    bins = sorted(map_batches(rows, binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    x = (np.array([r["bin"] for r in bins]) + 0.5) / (BINS / 2) - 0.5
    knots = isotonic(x, np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return Model(basis, _solve(whole[:-1, :-1], whole[:-1, -1], ridge), knots)


def scored(stats: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, score, predicted."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_rows(batch.column("s")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_batches(stats, run, "doc_id long, score double, predicted int")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo a number: deals rows into learnt and held out."""
    return F.crc32(doc_id.cast("string")) % modulus


def _known(labels: DataFrame, learnt: Column, label: str) -> DataFrame:
    return labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), label).filter(learnt)


def classify(docs: DataFrame, labels: DataFrame, learnt: Column, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every document; learns only where ``learnt`` holds of doc_id."""
    stats = settle(described(docs))
    return scored(stats, fit(stats.join(_known(labels, learnt, label), "doc_id"), label), threshold)


def accepted(docs: DataFrame, labels: DataFrame, learnt: Column, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that ``classify`` predicts as 1.

    Each row is judged by its own text where it is read, so rows that share a doc_id
    have nothing to do with each other and no text is shuffled.
    """
    stats = settle(described(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats.join(_known(labels, learnt, label), "doc_id"), label))
    forget(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in wk.slices(batch.column("text"), 1 << 20):
                good = model.value.score(statistics(batch.column("text")[i:j])) >= threshold
                if good.any():
                    yield batch.slice(i, j - i).filter(pa.array(good))

    return map_batches(docs, run, docs.schema)
