"""Masked statistics of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import base_type

IMAGE = ["tag", "date", "band"]


def mean_std(pixels: DataFrame, sample: bool = False) -> DataFrame:
    """Mean and deviation per image band; 0 where nothing is valid."""
    v = F.when(F.col("valid"), F.col("value"))
    deviation = F.stddev_samp(v) if sample else F.stddev_pop(v)
    return pixels.groupBy(*IMAGE).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(deviation, F.lit(0.0)).alias("std"))


def min_max_places(pixels: DataFrame) -> DataFrame:
    """Extremes and their first place in row-major order."""
    ok = pixels.filter("valid")
    place, low = F.struct("y", "x"), F.struct("value", "y", "x")
    high = F.struct(-F.col("value"), F.col("y"), F.col("x"))
    return ok.groupBy(*IMAGE).agg(F.min("value").alias("low"), F.min_by(place, low).alias("at_low"), F.max("value").alias("high"), F.min_by(place, high).alias("at_high"))


def unique_counts(pixels: DataFrame) -> DataFrame:
    return pixels.filter("valid").groupBy(*IMAGE, "value").agg(F.count("*").alias("n"))


def unused_value(pixels: DataFrame, dtype: str) -> float | None:
    """A value to stand for missing data that no valid cell has; None if there is none.

    At most the type's range of small integers is looked at.  Of wide types (int32 and
    floats) the customary value is given without looking, whatever the cells hold.
    """
    t = base_type(dtype)
    values = pixels.filter("valid").select("value").distinct()
    if not t.integral:
        return -9999.0
    if dtype == "int32":
        return -999999.0
    preferred = {"int16": -9999.0, "int8": -99.0}.get(dtype)
    if preferred is not None and not values.filter(F.col("value") == preferred).limit(1).count():
        return preferred
    span = pixels.sparkSession.range(int(t.low), int(t.high) + 1).select(F.col("id").cast("double").alias("value"))
    free = span.join(values, "value", "left_anti").agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    return free["a"] if t.low < 0 else free["b"]


def free_values(pixels: DataFrame, low: int, high: int) -> DataFrame:
    """Integers of a range that no valid cell has."""
    span = pixels.sparkSession.range(low, high + 1).select(F.col("id").cast("double").alias("value"))
    return span.join(pixels.filter("valid").select("value").distinct(), "value", "left_anti")


def with_nodata(filled: DataFrame, dtype: str) -> DataFrame:
    """Cells of state 0 and 64 of each tag get a value that none of its other cells has.

    A row per tag comes to the driver, and one value with it.
    """
    lost = F.col("state").isin(0, 64)
    left = filled.filter(~lost).withColumn("valid", F.col("value").isNotNull())
    chosen = F.lit(None).cast("double")
    for r in filled.select("tag").distinct().collect():
        value = unused_value(left.filter(F.col("tag") == r["tag"]), dtype)
        if value is not None:
            chosen = F.when(F.col("tag") == r["tag"], F.lit(value)).otherwise(chosen)
    return filled.withColumn("value", F.when(lost, F.coalesce(chosen, F.col("value"))).otherwise(F.col("value")))
