"""Token-ID output: documents as directly addressable codes, in ascending id order.

``write_tokens`` range-partitions by doc_id, encodes each text and writes files
of about ``PER_FILE`` ids; each is one blob in the layout of ``dac``, stored as
a row of a Parquet table so that any store Spark can write will do.  The table is
not compressed: a token is read by its address, without decoding a block.
``read_tokens`` reads the blobs back.  A document is never split over two blobs.
With a ``path`` the table is written there and stays; without, it is an intermediate
one and goes with the session.

Null texts are empty and get the end id alone; a null doc_id sorts first; rows
with the same doc_id are all written, in any order among themselves but never over two
range partitions; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import dac
from tessera.llm import wordkernel as wk
from tessera.llm.frames import map_batches, settle
from tessera.llm.unit_encoder import encoder

PER_FILE = 1 << 19
FILE_SCHEMA = "part long, piece long, start_in_part long, n_tokens long, doc_ids binary, doc_known binary, blob binary"
ROW_SCHEMA = "part long, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, keeps_space: bool = True, path: str | None = None) -> DataFrame:
    """The table of written files, at ``path`` if one is given."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(vocabulary, keeps_space), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = piece = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, piece, start
            doc_ids = pa.array([d for h in held for d in h[0]], pa.int64())
            ids = np.concatenate([h[1] for h in held])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))])
            row = [part, piece, start, len(ids), doc_ids.fill_null(0).to_numpy().tobytes(), np.asarray(doc_ids.is_valid()).tobytes(), dac.pack(ids, bounds)]
            held, size, piece, start = [], 0, piece + 1, start + len(ids)
            kinds = [pa.int64()] * 4 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            texts = batch.column("text")
            for i, j in wk.slices(texts, 1 << 19):
                ids, bounds = code.encode(texts[i:j])
                counts = np.diff(bounds) + 1
                ends = np.cumsum(counts) - 1
                full = np.full(len(ids) + len(counts), end_id, np.uint32)
                inner = np.ones(len(full), bool)
                inner[ends] = False
                full[inner] = ids
                held.append((batch.column("doc_id")[i:j].to_pylist(), full, counts))
                size += len(full)
                if size >= PER_FILE:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    table = map_batches(ordered, files, FILE_SCHEMA)
    if path is None:
        return settle(table, codec="uncompressed", per_file=4)
    table.write.option("compression", "uncompressed").option("maxRecordsPerFile", 4).parquet(path)
    return docs.sparkSession.read.schema(FILE_SCHEMA).parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """Rows of documents as the files hold them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, b=batch, r=r: b.column(c)[r].as_py()
                reader = dac.Reader(get("blob"))
                ids, bounds = reader.ids(), reader.bounds
                n = len(bounds) - 1
                doc_ids = np.frombuffer(get("doc_ids"), np.int64)
                known = np.frombuffer(get("doc_known"), bool)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, get("part"))), pa.array(doc_ids, mask=~known), pa.array(get("start_in_part") + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc)],
                    names=[c.split()[0] for c in ROW_SCHEMA.split(", ")],
                )

    return map_batches(files, rows, ROW_SCHEMA)


def token_table(docs: DataFrame, vocabulary: str, end_id: int, keeps_space: bool = True, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files.

    The driver sees one total for each range partition.
    """
    files = write_tokens(docs, vocabulary, end_id, keeps_space, path)
    totals = sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, before, strict=False)], "part long, before long")
    return (
        read_tokens(files)
        .join(F.broadcast(offsets), "part")  # as many rows as there are partitions
        .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
    )
