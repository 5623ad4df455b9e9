"""Mixing sources to target weights by the cube method.

A source whose target is m times its size takes every document floor(m) times
and a balanced sample of the rest: inclusion probabilities m - floor(m) move
through the null space of two constraints, tokens and documents, until they are
0 or 1.  A step moves three documents; what it keeps constant is exact, so the
sample's tokens equal their expectation until at most two documents are left.

*Flight*: a source is dealt into blocks by a hash of doc_id, longest documents
first inside a block, so what a block can't decide is short.  Leftovers of all
blocks fly again, level by level, until one block of a source is left.
*Landing*: the last documents of a source and a dozen shorter ones are decided by
trial to come nearest its tokens.
*Evening out*: a dozen documents can't always make up for a long one.  A source that
still misses its target by a word or more has the copies of some documents raised or
lowered by one, chosen from the histogram of its lengths, so from all its documents.
Only where that leaves more than a thousandth of the target may a document be taken
any number of times up to ``most``; what is missed then is what whole documents allow.

Null texts have size 0; a null source is a source, the last one; repeated rows
are drawn one by one; other columns are ignored; an empty table gives an empty
result.  The random choices depend on ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

import functools
import math
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import wordkernel as wk
from tessera.llm.frames import columns, fresh, map_batches, settle

BLOCK = 2000
TINY = 1e-9
#: Documents decided anew with the last fractions; the landing tries 2 to the power of this.
REOPEN = 12
#: Part of its target that a source may miss before documents leave the two numbers of copies next to its mean.
NEAR = 0.001
#: Sums that evening out looks at, either way; more where documents are longer.
WIDE = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = wk.text_bytes(batch.column("text"))
            n = wk.split_words(data, bounds).counts
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n.astype(np.int64))], names=["doc_id", "source", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return map_batches(rows, count, "doc_id long, source string, size long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Target of each source: share by weight, cap, and share the excess again."""
    order = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    goal = share * sum(n for _, n in order)
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s, _ in order if s not in fixed]
        left = goal - sum(fixed.values())
        total = sum(weight[s] for s in free)
        part = {s: left * weight[s] / total for s in free}
        over = [s for s in free if part[s] > cap[s]]
        if not over:
            return fixed | part
        fixed |= {s: cap[s] for s in over}


def fly(size: list[float], p: list[float], rng: random.Random) -> list[float]:
    """Move p through the null space of (sum p, sum size p) until at most two are fractional."""
    p = list(p)
    waiting = iter(range(len(p)))
    held: list[int] = []
    while True:
        while len(held) < 3:
            i = next(waiting, None)
            if i is None:
                break
            if TINY < p[i] < 1 - TINY:
                held.append(i)
            else:
                p[i] = float(round(p[i]))
        if len(held) == 3:
            a, b, c = held
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(held, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(held, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(held, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * d))
            if p[i] < TINY or p[i] > 1 - TINY:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0.0 < p[i] < 1.0]


def land(size: list[float], p: list[float], reopen: int = REOPEN) -> list[float]:
    """Decide the last fractions so that tokens, then documents, come nearest.

    A fraction of a long document can't be rounded without missing the target,
    so ``reopen`` documents, from the shortest up to its length, are decided anew
    with it.
    """
    open_ = [i for i, v in enumerate(p) if 0.0 < v < 1.0]
    if not open_:
        return p
    longest = max(size[i] for i in open_)
    near = sorted((i for i, v in enumerate(p) if v in (0.0, 1.0) and 0 < size[i] <= longest), key=lambda i: (size[i], i))
    again = [near[j] for j in sorted({round(x) for x in np.linspace(0, len(near) - 1, reopen)})] if near else []
    every = open_ + again
    width = np.array([size[i] for i in every])
    now = np.array([p[i] for i in every])
    choice = (np.arange(1 << len(every))[:, None] >> np.arange(len(every)) & 1).astype(float)
    missed = np.abs(choice @ width - now @ width)
    moved = np.abs(choice - now).sum(1)
    best = choice[np.lexsort((moved, np.abs(choice.sum(1) - now.sum()), missed.round(6)))[0]]
    out = list(p)
    for i, v in zip(every, best.tolist(), strict=True):
        out[i] = v
    return out


def even_out(gap: int, size: list[int], more: list[int], less: list[int]) -> list[int]:
    """How many copies of each size to add, or to drop if negative, so that their words come nearest gap.

    ``more`` and ``less`` bound what can be added and dropped.  The longest that fit
    are moved first; the rest is a subset sum over what can still be moved either
    way, from the shortest, which ends as soon as it is met.
    """
    units, left, sign = [0] * len(size), abs(gap), 1 if gap > 0 else -1
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        n = min((more if gap > 0 else less)[i], left // size[i])
        units[i] = sign * n
        left -= n * size[i]
    if not left:
        return units
    free = [(more[i] - u, less[i] + u) for i, u in enumerate(units)]
    part = math.gcd(*size) or 1
    size, left = [s // part for s in size], sign * left / part
    half = min(sum(s * (a + b) for s, (a, b) in zip(size, free, strict=True)), max(WIDE, round(abs(left)) + 2 * max(size, default=0)))
    first = np.full(2 * half + 1, -1, np.int32)  # of each sum from -half on, the step that reached it first
    first[half] = 0
    want = half + max(-half, min(half, round(left)))
    steps, low, high = [(0, 0)], 0, 0
    for i in sorted(range(len(size)), key=lambda i: size[i]):
        for way, most in zip((1, -1), free[i], strict=True):
            most, n = min(most, 2 * half // size[i]), 1
            while most and first[want] < 0:
                n = min(n, most)
                by = way * n * size[i]
                start, end = max(low, -half - by), min(high, half - by) + 1
                if start < end:
                    here, there = first[half + start : half + end], first[half + start + by : half + end + by]
                    there[(here >= 0) & (there < 0)] = len(steps)
                    low, high = min(low, start + by), max(high, end - 1 + by)
                steps.append((i, way * n))
                most, n = most - n, 2 * n
    reached = np.flatnonzero(first >= 0)
    at = int(reached[np.lexsort((np.abs(reached - half), np.abs(reached - half - left)))[0]])
    while at != half:
        i, n = steps[first[at]]
        units[i] += n
        at -= n * size[i]
    return units


LEVEL_SCHEMA = "doc_id long, source string, size long, source_size long, target double, base int, p double"


def _flight(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The flight of one block; with ``last``, its landing too."""

    def flight(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].fillna(-1).to_numpy().astype(np.int64)
        pdf = pdf.iloc[np.lexsort((ids, wk.mix64(ids.astype(wk.U64)), -pdf["size"].to_numpy()))]
        seed = zlib.crc32(f"{level}|{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}".encode())
        size = pdf["size"].astype(float).tolist()
        p = fly(size, pdf["p"].tolist(), random.Random(seed))
        return pdf.assign(p=land(size, p) if last else p)[[c.split()[0] for c in LEVEL_SCHEMA.split(", ")]]

    return flight


def _evening(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The copies to add to each length of a source, of documents taken equally often."""

    def evening(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "copies"])
        size, copies, n = (pdf[c].tolist() for c in ("size", "copies", "n"))
        target, base = pdf["target"].iloc[0], pdf["base"].iloc[0]
        gap = round(target - sum(s * c * k for s, c, k in zip(size, copies, n, strict=True)))
        units = even_out(gap, size, [k if c == base else 0 for c, k in zip(copies, n, strict=True)], [k if c > base else 0 for c, k in zip(copies, n, strict=True)])

        def missed(units: list[int]) -> int:
            return abs(gap - sum(s * u for s, u in zip(size, units, strict=True)))

        if missed(units) > NEAR * target:
            units = min(units, even_out(gap, size, [k * (most - c) for c, k in zip(copies, n, strict=True)], [k * c for c, k in zip(copies, n, strict=True)]), key=missed)
        return pdf.assign(units=units).query("units != 0")[[c.split()[0] for c in MOVE_SCHEMA.split(", ")]]

    return evening


MOVE_SCHEMA = "source string, size long, copies int, units long, n long"


def _evened(flown: DataFrame, goal: dict[str | None, float], most: int) -> DataFrame:
    """flown with other copies in the sources whose words miss their target by one or more."""
    words = flown.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).collect()
    off = [(r["source"],) for r in words if abs(goal[r["source"]] - r["words"]) >= 1]
    if not off:
        return flown
    off_df = flown.sparkSession.createDataFrame(off, "source string")
    theirs = flown.filter("size > 0").join(F.broadcast(off_df), flown["source"].eqNullSafe(off_df["source"]), "left_semi")
    lengths = theirs.groupBy("source", "size", "copies").agg(F.count("*").alias("n"), F.first("target").alias("target"), F.first("base").alias("base"))
    moves = F.broadcast(settle(lengths.groupBy("source").applyInPandas(_evening(most), MOVE_SCHEMA)).toDF("_source", "_size", "_copies", "_units", "_n"))
    same = flown["source"].eqNullSafe(moves["_source"]) & (flown["size"] == moves["_size"]) & (flown["copies"] == moves["_copies"])
    # of documents alike in length and copies, the first ones move one more
    order = Window.partitionBy("source", "size", "copies").orderBy(F.xxhash64("doc_id"), "doc_id")
    moved = flown.join(moves, same).withColumn("_rank", F.row_number().over(order))
    each = F.floor(F.abs("_units") / F.col("_n")) + F.when(F.col("_rank") <= F.abs("_units") % F.col("_n"), 1).otherwise(0)
    moved = moved.withColumn("copies", (F.col("copies") + F.signum("_units") * each).cast("int"))
    return flown.join(moves, same, "left_anti").unionByName(moved.select(*columns(flown)))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Each row of docs, with all its columns, as many times as the mix takes it.

    Rows are told apart by doc_id, source and size.  Rows that have all three alike are
    all the same to the mix; what it takes of them is dealt out among them evenly.
    """
    key = ["_id", "_source", "_size"]
    names = {c: fresh(docs, c) for c in (*key, "_many", "_rows", "_rank")}
    id_, source, size, many, rows, rank = names.values()
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)))
    taken = mix(docs, weights, share, most).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(many), F.count("*").alias(rows)).filter(F.col(many) > 0)
    taken = taken.toDF("_t_id", "_t_source", "_t_size", many, rows)
    own = docs.select("*", F.col("doc_id").cast("long").alias(id_), F.col("source").cast("string").alias(source), words.cast("long").alias(size))
    same = own[id_].eqNullSafe(taken["_t_id"]) & own[source].eqNullSafe(taken["_t_source"]) & (own[size] == taken["_t_size"])
    found = own.join(taken, same).drop(*(taken[c] for c in ("_t_id", "_t_source", "_t_size")))
    alone = found.filter(F.col(rows) == 1)
    # rows alike in all three: the first ones take one more
    order = Window.partitionBy(id_, source, size).orderBy(F.xxhash64(*columns(docs)))
    alike = found.filter(F.col(rows) > 1).withColumn(rank, F.row_number().over(order))
    each = (F.floor(F.col(many) / F.col(rows)) + F.when(F.col(rank) <= F.col(many) % F.col(rows), 1).otherwise(0)).cast("long")
    spread = alone.select(*columns(docs), F.col(many)).unionByName(alike.select(*columns(docs), each.alias(many)).filter(F.col(many) > 0))
    return spread.select(*columns(docs), F.explode(F.sequence(F.lit(1), F.col(many))).alias(rank)).drop(rank)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    The driver gathers one row per source.
    """
    spark = docs.sparkSession
    sized = settle(sizes(docs))
    totals = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
    goal = targets([t[:2] for t in totals], weights, share, most) if totals else {}
    plan = []
    for source, size, n in totals:
        m = goal[source] / size if size else 0.0
        base = min(int(m + TINY), int(most))
        plan.append((source, size, goal[source], base, max(0.0, m - base), -(-n // block)))
    plan_df = spark.createDataFrame(plan, "source string, source_size long, target double, base int, p double, blocks long")
    rows = sized.join(F.broadcast(plan_df), sized["source"].eqNullSafe(plan_df["source"])).drop(plan_df["source"])  # a row per source
    rows = rows.withColumn("blocks", F.when((F.col("p") > TINY) & (F.col("p") < 1 - TINY), F.col("blocks")))
    columns = ["doc_id", "source", "size", "source_size", "target", "base", "p"]
    sure = rows.filter("blocks is null").select(*columns)
    level, done = 0, [sure]
    rows = rows.filter("blocks is not null").select(*columns, "blocks")
    while True:
        last = all(b <= 1 for *_, b in plan)

        salted = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.col("blocks")))
        flown = settle(salted.groupBy("source", "block").applyInPandas(_flight(level, last), LEVEL_SCHEMA))
        if last:
            done.append(flown)
            break
        done.append(flown.filter("p = 0 or p = 1"))
        rows = flown.filter("p > 0 and p < 1")
        plan = [(s, n, t, b, p, -(-2 * k // block)) for s, n, t, b, p, k in plan]  # at most two are left of each block
        counts = spark.createDataFrame([(s, k) for s, *_, k in plan], "source string, blocks long")
        rows = rows.join(F.broadcast(counts), rows["source"].eqNullSafe(counts["source"])).drop(counts["source"])
        level += 1
    sure, *others = (d.withColumn("copies", F.col("base") + F.round("p").cast("int")) for d in done)
    out = sure.unionByName(_evened(functools.reduce(DataFrame.unionByName, others), goal, int(most)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies").withColumn("taken", F.col("size") * F.col("copies"))
