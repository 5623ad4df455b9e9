"""Small helpers every operator of this subpackage uses.

Intermediate results are cut off with Parquet tables in the shared folder that
``spark.checkpoint.dir`` names, so a lost executor costs a re-read and not a
recomputation.  Only where the session names no folder (tests, a laptop) is a
temporary one made.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one if the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, codec: str = "snappy", per_file: int = 0) -> DataFrame:
    """Write df to the shared folder as Parquet and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    _made.append((spark, path))
    writer = df.write.option("compression", codec)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    # the table replaces what was shuffled for it, so those files go as soon as it is written
    kept = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, kept) if kept is not None else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/settled-" in path:
                _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already: nothing left to tidy with
            return


def _give_back() -> None:
    """Return freed memory to the system: idle workers stay alive beside busy ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded in bytes; the bound stays set, as the plan reads it when it runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def columns(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
