"""The data model: dated, tagged, multi-band rasters as DataFrames.

``pixels`` is the long form: tag, date, y, x, band, value, valid.  A raster is
*dense*: every cell of its grid has a row, missing ones with a null value and
valid = false.  Window sums over rows and then columns are exact only then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ImageTypeError

PIXELS = "tag string, date int, y int, x int, band int, value double, valid boolean"


@dataclass(frozen=True)
class BaseType:
    """Range of a base type; ``low`` and ``high`` also scale colours."""

    name: str
    low: float
    high: float
    integral: bool

    @property
    def widened(self) -> str:
        return {"int8": "int16", "uint8": "int16", "int16": "int32", "uint16": "int32"}.get(self.name, self.name)


TYPES = {
    t.name: t
    for t in (
        BaseType("int8", -128, 127, True), BaseType("uint8", 0, 255, True), BaseType("int16", -32768, 32767, True), BaseType("uint16", 0, 65535, True),
        BaseType("int32", -(2**31), 2**31 - 1, True), BaseType("float32", 0, 1, False), BaseType("float64", 0, 1, False),
    )
}


def base_type(name: str) -> BaseType:
    if name not in TYPES:
        raise ImageTypeError(f"unknown base type {name!r}")
    return TYPES[name]


def saturate(value: Column, dtype: str) -> Column:
    """Round half to even and clamp to the type; floats pass through."""
    t = base_type(dtype)
    return F.least(F.greatest(F.rint(value), F.lit(t.low)), F.lit(t.high)) if t.integral else value


def truncate(value: Column, dtype: str) -> Column:
    """Cut the fraction off, towards zero, and clamp; floats pass through."""
    t = base_type(dtype)
    cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")
    return F.least(F.greatest(cut, F.lit(t.low)), F.lit(t.high)) if t.integral else value


def densify(pixels: DataFrame, height: int, width: int, keys: DataFrame) -> DataFrame:
    """Add the missing cells of every image named by keys (tag, date, band)."""
    spark = pixels.sparkSession
    cells = spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    grid = cells.crossJoin(F.broadcast(keys))  # one row per image band
    out = grid.join(pixels, ["tag", "date", "band", "y", "x"], "left")
    return out.select("tag", "date", "y", "x", "band", "value", F.coalesce("valid", F.lit(False)).alias("valid"))


def fine_raster(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """A wide raster (x, y, d, b0, b1, b2, qa, ok) derived from lineitem."""
    cell = F.col("l_orderkey") % (side * side)
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy((cell % side).cast("int").alias("x"), (cell / side).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("d"))
        .agg(
            (F.sum(F.col("l_quantity").cast("bigint")) % 256).cast("int").alias("b0"),
            (F.sum("l_partkey") % 256).cast("int").alias("b1"),
            (F.sum("l_suppkey") % 256).cast("int").alias("b2"),
            (F.max("l_suppkey") % 256).cast("int").alias("qa"),
            F.bool_or(F.col("l_returnflag") == "N").alias("ok"),
        )
    )


def dense_raster(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """The fine raster with every cell of its grid and dates 1 to 7."""
    grid = spark.range(side * side * 7).select(
        (F.col("id") % side).cast("int").alias("x"), ((F.col("id") / side).cast("int") % side).cast("int").alias("y"), ((F.col("id") / (side * side)).cast("int") + 1).cast("int").alias("d")
    )
    return grid.join(fine_raster(spark, sf_dir, side), ["x", "y", "d"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def long_form(wide: DataFrame, tag: str, bands: list[str]) -> DataFrame:
    """Pixels of a wide raster, one row per band."""
    pairs = ", ".join(f"{i}, cast({b} as double)" for i, b in enumerate(bands))
    return wide.select(F.lit(tag).alias("tag"), F.col("d").alias("date"), "y", "x", "ok", F.expr(f"stack({len(bands)}, {pairs}) as (band, value)")).select("tag", "date", "y", "x", "band", "value", (F.col("ok") & F.col("value").isNotNull()).alias("valid"))


def low_raster(dense: DataFrame, factor: int = 4) -> DataFrame:
    """Block means of a dense raster, replicated on its own grid."""
    from pyspark.sql import Window

    block = Window.partitionBy("d", F.floor(F.col("x") / factor), F.floor(F.col("y") / factor))
    mean = lambda b: F.floor(F.sum(b).over(block) / F.count(b).over(block)).cast("int").alias(b)
    return dense.select("x", "y", "d", *[mean(b) for b in ("b0", "b1", "b2")], F.lit(True).alias("ok"))
