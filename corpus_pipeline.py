"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``ORACLE_SQL`` is None: a learnt classifier, a
balanced sample and a packing have no SQL; the tests hold the stages against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit, cube_mix, quality, recompression, voronoi_join
from tessera.llm.frames import columns, settle
from tessera.llm.queries import vocabulary

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, each judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, quality.remainder(F.col("doc_id"), 5) != 0, threshold=0.3)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each near-duplicate component; unlike texts stay whatever their ids."""
    return voronoi_join.one_each(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that long repeats cover; a text that loses all its words goes."""
    found = recompression.dedup(docs.select("doc_id", "text", F.struct(*columns(docs)).alias("row")), k=20, tidy=False)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.filter("n_removed = 0 or n_removed < n_words").select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    return cube_mix.mixed_rows(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return best_fit.pack(docs, vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
