"""Temporal gap filling per pixel and band, one shuffle for everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.model import saturate

#: What became of a value.
NODATA, LEFT_OUT, CLEAR, FILLED = 0, 64, 128, 192


@dataclass(frozen=True)
class InterpolationOptions:
    limit_days: int = 5
    interp_invalid: bool = True
    prefer_interpolation: bool = True
    dtype: str = "float64"
    nodata: float | None = None

    def __post_init__(self) -> None:
        if self.limit_days < 0:
            raise InvalidArgument("limit_days can't be negative")


def interpolate(pixels: DataFrame, flag: Column, options: InterpolationOptions = InterpolationOptions(), by_pixel: bool = True) -> DataFrame:
    """pixels with value filled and ``state``.

    ``flag`` asks for interpolation of a value; with ``by_pixel`` one flagged band
    flags the whole pixel.  With ``interp_invalid`` an invalid band does so too and
    nothing is invalid any more.  Values come from the nearest unflagged valid dates
    at most ``limit_days`` away, always from the original images.
    """
    pixel = Window.partitionBy("tag", "date", "y", "x")
    series = Window.partitionBy("tag", "y", "x", "band").orderBy("date")
    n = options.limit_days
    asked = F.coalesce(flag, F.lit(False))
    valid = F.coalesce(F.col("valid"), F.lit(False))
    if options.interp_invalid:
        asked, valid = asked | ~valid, F.lit(True)
    if by_pixel:
        asked = F.max(asked).over(pixel)
    df = pixels.withColumn("_ask", asked).withColumn("_valid", valid)
    source = F.when(~F.col("_ask") & F.col("_valid") & F.col("value").isNotNull(), F.struct("date", "value"))
    left = F.last(source, ignorenulls=True).over(series.rangeBetween(-n, -1)) if n else F.lit(None).cast("struct<date:int,value:double>")
    right = F.first(source, ignorenulls=True).over(series.rangeBetween(1, n)) if n else F.lit(None).cast("struct<date:int,value:double>")
    df = df.withColumn("_l", left).withColumn("_r", right)
    line = F.col("_l.value") + (F.col("date") - F.col("_l.date")) * (F.col("_r.value") - F.col("_l.value")) / (F.col("_r.date") - F.col("_l.date"))
    filled = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), saturate(line, options.dtype)).otherwise(F.coalesce("_l.value", "_r.value"))
    invalid = ~F.col("_valid") & (~F.col("_ask") if options.prefer_interpolation else F.lit(True))
    state = F.when(invalid, NODATA).when(~F.col("_ask"), CLEAR).when(filled.isNull(), LEFT_OUT).otherwise(FILLED).cast("smallint")
    lost = F.col("value") if options.nodata is None else F.lit(float(options.nodata))
    value = F.when(F.col("state") == FILLED, filled).when(F.col("state") == CLEAR, F.col("value")).otherwise(lost)
    return df.withColumn("state", state).withColumn("value", value).select("tag", "date", "y", "x", "band", "value", "state")


def statistics(filled: DataFrame) -> DataFrame:
    """Counts per image: values, nodata, asked for and filled."""
    s = F.col("state")
    return filled.groupBy("tag", "date").agg(
        F.count("*").alias("n_values"), F.count_if(s == NODATA).alias("n_nodata"), F.count_if((s == LEFT_OUT) | (s == FILLED)).alias("n_interp_before"), F.count_if(s == LEFT_OUT).alias("n_interp_after")
    )


def layer_flags(pixels: DataFrame, layers: DataFrame, value: str = "flag", fold: str = "or") -> DataFrame:
    """Join quality or mask layers on (tag, date); a layer without a tag holds for all.

    Flags of both kinds are OR-ed, masks AND-ed.
    """
    own = layers.filter("tag <> ''").withColumnRenamed(value, "_own")
    shared = layers.filter("tag = ''").drop("tag").withColumnRenamed(value, "_all")
    df = pixels.join(own, ["tag", "date", "y", "x"], "left").join(shared, ["date", "y", "x"], "left")
    rest = F.lit(fold == "and")
    a, b = F.coalesce("_own", rest), F.coalesce("_all", rest)
    return df.withColumn(value, (a & b) if fold == "and" else (a | b)).drop("_own", "_all")
