"""Exact top-k by inner product over norm-sorted, rotated vectors.

Vectors are quantised to integers, sorted by descending length and packed into
slabs.  A rotation from the eigenvectors of the Gram matrix (the right singular
vectors of the whole table) moves weight to the first coordinates.  A query
scores the leading slab in full; its k-th best score is a threshold for the
rest: a slab goes if |q| |c| can't reach it (Cauchy-Schwarz), a pair goes if the
partial sum over the first rotated coordinates plus the product of the residual
lengths can't.  What is left is scored in integers, so results are exact.

A query block meets candidates slab group by slab group: the group's slabs are in
one task, the block is sent there once, goes through them in the order of their norms
and raises its thresholds on the way.  Vectors travel as integers of the smallest width
that holds them.  A block gives at most k rows for each query and group.

A query is a row, not an id: rows that repeat a vec_id are queries and candidates
each, and all rows but the query's own are its candidates.  Vectors that are null or hold
null or non-finite components take no part; shorter vectors are padded with zeros; ties go
to the smaller vec_id; null vec_ids are dropped; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import map_batches, settle

SLAB = 4096
QUERIES = 1024
LEAD = 16
SLACK = 1e-6
#: Slabs a task holds at most.
HELD = 16
NO_LIMIT = np.iinfo(np.int64).max
PACKED = "block long, most double, rows binary, ids binary, kind string, vectors binary"


def quantise(vectors: DataFrame, scale: float) -> DataFrame:
    """row (a number of its own), vec_id, v (array of long): floor(scale * x); unusable vectors are gone."""
    x = F.col("embedding").cast("array<double>")
    # NaN equals NaN in Spark SQL, so both tests are plain comparisons
    usable = F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, strongest first; the driver sees dim x dim sums."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "s"])

    cells = map_batches(vectors.select("v"), gram, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    g = np.zeros(dim * dim)
    for r in cells:
        g[r["cell"]] = r["s"]
    return np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1].copy()


def _smallest(m: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them all."""
    most = float(np.abs(m).max(initial=0.0))
    return m.astype(next((t for t, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if most <= top), "<f8"))


def pack(vectors: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of vectors in descending order of length."""
    from pyspark import TaskContext

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            small = _smallest(m)
            row = [(part << 32) + made - 1, float(np.sqrt((m * m).sum(1).max())), rows.tobytes(), ids.tobytes(), small.dtype.str, small.tobytes()]
            kinds = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            held.append((batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim)))
            n += batch.num_rows
            if n >= size:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                for a in range(0, n - size + 1, size):
                    yield out(*(e[a : a + size] for e in every))
                held, n = [tuple(e[n - n % size :] for e in every)], n % size
        if n:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    ordered = vectors.withColumn("length", length).repartitionByRange(F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id", "row")
    return settle(map_batches(ordered.select("row", "vec_id", "v"), blocks, PACKED), per_file=16)


def best(scores: np.ndarray, qi: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best (score down, id up)."""
    order = np.lexsort((ids, -scores, qi))
    q = qi[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


class Block:
    """Vectors with their rotated leading parts and the lengths of what is left of them."""

    def __init__(self, row: dict, dim: int, turn: np.ndarray):
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.most = row["most"]
        self.v = np.frombuffer(row["vectors"], row["kind"]).astype(np.float64).reshape(-1, dim)
        h = min(LEAD, dim)
        turned = self.v @ turn
        self.lead, self.rest = turned[:, :h], np.sqrt((turned[:, h:] ** 2).sum(1))
        self.length = float(np.sqrt((self.v**2).sum(1).max()))


def meet(q: Block, c: Block, floor: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best pairs of two blocks above each query's floor, or at it with an id below ``limit``: positions in both and scores."""
    if np.isneginf(floor).all():
        s = q.v @ c.v.T
        s[q.rows[:, None] == c.rows[None, :]] = -np.inf
        if s.shape[1] > k:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            qi, ci = np.nonzero((s >= kth[:, None]) & ~np.isneginf(s))
        else:
            qi, ci = np.nonzero(~np.isneginf(s))
        score = s[qi, ci]
    else:
        bound = q.lead @ c.lead.T
        bound += q.rest[:, None] * c.rest[None, :]
        bound *= 1 + SLACK
        bound += SLACK
        qi, ci = np.nonzero(bound >= floor[:, None])
        if len(qi) * 8 > bound.size:  # few were pruned: one matrix product is cheaper
            score = (q.v @ c.v.T)[qi, ci]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q.v[qi[a : a + 65536]], c.v[ci[a : a + 65536]]) for a in range(0, len(qi), 65536)] or [np.zeros(0)])
        keep = ((score > floor[qi]) | ((score == floor[qi]) & (c.ids[ci] < limit[qi]))) & (q.rows[qi] != c.rows[ci])
        qi, ci, score = qi[keep], ci[keep], score[keep]
    top = best(score, qi, c.ids[ci], k)
    return qi[top], ci[top], score[top]


def through(q: Block, slabs: list[Block], floor: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A query block's best pairs with slabs in descending order of norms; the floors rise on the way.

    Positions of queries, vec_ids and scores, at most k of each query.
    """
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    floor, limit = floor.copy(), limit.copy()
    for c in slabs:
        if (q.length * c.length * (1 + SLACK) + SLACK < floor).all():
            break  # Cauchy-Schwarz: no later slab is longer
        qi, ci, s = meet(q, c, floor, limit, k)
        merged = [np.concatenate(x) for x in zip(found, (qi, c.ids[ci], s), strict=True)]
        top = best(merged[2], merged[0], merged[1], k)
        found = tuple(m[top] for m in merged)
        # the last of k found ones is the new floor: what ties with it needs a smaller id
        count = np.bincount(found[0], minlength=len(floor))
        full, last = np.flatnonzero(count >= k), (np.cumsum(count) - 1)[count >= k]
        score, ids = found[2][last], found[1][last]
        up = (score > floor[full]) | ((score == floor[full]) & (ids < limit[full]))
        floor[full[up]], limit[full[up]] = score[up], ids[up]
    return found


FOUND = "query long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query."""
    spark = vectors.sparkSession
    rows = settle(quantise(vectors, scale))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    turn = spark.sparkContext.broadcast(rotation(rows, dim))
    slabs = pack(rows, dim, SLAB)
    asks = pack(rows.filter(F.col("vec_id") % every == 0), dim, QUERIES)
    blocks = slabs.agg(F.min("block"), F.count("*")).first()
    if blocks[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many slabs for a task as it may hold, but tasks enough for all cores
    width = max(1, min(HELD, blocks[1] // (2 * spread)))
    lead, fields = F.col("block") == blocks[0], ("block", "most", "rows", "ids", "kind", "vectors")

    def ranked(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group: its slabs by descending norms, then query blocks."""
        group, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["team"] != group:
                    group, held = row["team"], []
                block = Block(row, dim, turn.value)
                if row["query"] == 0:
                    held.append(block)
                    continue
                known = {f["query"]: (f["score"], f["vec_id"]) for f in row["floors"] or ()}
                floor, limit = (np.array(x) for x in zip(*(known.get(i, (-np.inf, NO_LIMIT)) for i in block.rows.tolist()), strict=True))
                qi, ids, s = through(block, held, floor.astype(float), limit.astype(np.int64), k)
                yield pa.RecordBatch.from_arrays([pa.array(block.rows[qi]), pa.array(block.ids[qi]), pa.array(ids), pa.array(s.astype(np.int64))], names=[c.split()[0] for c in FOUND.split(", ")])

    def against(group: DataFrame, queries: DataFrame) -> DataFrame:
        """Results of query blocks (team, floors and fields) with the slabs of their team."""
        none = F.lit(None).cast("array<struct<query:long,score:long,vec_id:long>>")
        both = group.select("team", F.lit(0).alias("query"), *fields, none.alias("floors")).unionByName(queries.select("team", F.lit(1).alias("query"), *fields, "floors"))
        return map_batches(both.repartition(spread * 2, "team").sortWithinPartitions("team", "query", F.desc("most"), "block"), scored, FOUND)

    # the leading slab gives thresholds; blocks of queries are dealt to as many copies of it as there are tasks
    none = F.lit(None).cast("array<struct<query:long,score:long,vec_id:long>>").alias("floors")
    copies = spark.range(spread).select(F.col("id").alias("team"))
    first_slab = slabs.filter(lead).crossJoin(F.broadcast(copies))  # one block for each task
    first = settle(against(first_slab, asks.select(F.pmod(F.xxhash64("block"), F.lit(spread)).alias("team"), *fields, none)))
    reach = ranked(first).filter(F.col("rank") == k).select("query", "score", "vec_id")
    owner = map_batches(asks.select("block", "rows"), _owners, "block long, query long")
    floors = owner.join(reach, "query", "left").groupBy("block").agg(
        F.collect_list(F.when(F.col("score").isNotNull(), F.struct("query", "score", "vec_id"))).alias("floors"),
        F.min(F.coalesce("score", F.lit(-(1 << 62)))).alias("least"),
    )
    # neighbours in the order of norms: a block's number is its range partition and its place there
    place = F.col("block") % (1 << 32)
    others = slabs.filter(~lead).withColumn("team", F.col("block") - place + F.floor(place / width))
    longest = others.groupBy("team").agg(F.max("most").alias("t_most"))
    sent = asks.join(floors, "block")
    # blocks, not rows: the stated query set against groups of slabs, where the product of lengths can reach a threshold
    near = F.col("most") * F.col("t_most") * (1 + SLACK) + SLACK >= F.col("least")
    pairs = sent.select("block", "most", "least").crossJoin(F.broadcast(longest)).filter(near).select("block", "team")
    rest = against(others, pairs.join(sent, "block"))
    found = ranked(ranked(first).drop("rank").unionByName(rest))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            rows = np.frombuffer(batch.column("rows")[r].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), batch.column("block")[r].as_py())), pa.array(rows)], names=["block", "query"])
