"""Resampling of images between grids, also of different spatial reference systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.functions.geo import GeoTransform
from tessera.functions.srs import projection_to_projection

#: Reach of a method in source cells, and the parameter of the cubic kernel.
REACH = {"nearest": 0, "bilinear": 1, "cubic": 2, "cubic_spline": 2}
SHARPNESS = -0.5


def _cubic(t: Column) -> Column:
    a, near = SHARPNESS, ((SHARPNESS + 2) * t - (SHARPNESS + 3)) * t * t + 1
    return F.when(t <= 1, near).when(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a).otherwise(0.0)


def _spline(t: Column) -> Column:
    return F.when(t <= 1, (4 - 6 * t * t + 3 * t * t * t) / 6).when(t < 2, (2 - t) * (2 - t) * (2 - t) / 6).otherwise(0.0)


_KERNELS = {"bilinear": lambda t: F.greatest(1 - t, F.lit(0.0)), "cubic": _cubic, "cubic_spline": _spline}


def warp(pixels: DataFrame, source: GeoTransform, target: GeoTransform, height: int, width: int, method: str = "nearest", source_srs: str = "", target_srs: str = "") -> DataFrame:
    """Images on a target grid of height x width; cells without a valid source are null.

    Cell centres are mapped.  Invalid and missing neighbours are left out and the weights
    of the others renewed.  The grid is small next to the pixels of many images, and each
    of its cells meets 1, 4 or 16 source cells by an equi-join.
    """
    if method not in REACH:
        raise InvalidArgument(f"no such method: {method!r}")
    cells = pixels.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("ty"), (F.col("id") % width).cast("int").alias("tx"))
    px, py = target.image_to_projection(F.col("tx") + 0.5, F.col("ty") + 0.5)
    if source_srs or target_srs:
        px, py = projection_to_projection(px, py, target_srs, source_srs)
    sx, sy = source.projection_to_image(px, py)
    if method == "nearest":
        spots = cells.select("ty", "tx", F.floor(sx).cast("int").alias("x"), F.floor(sy).cast("int").alias("y"), F.lit(1.0).alias("_w"))
    else:
        steps = range(1 - REACH[method], REACH[method] + 1)
        spots = cells.select("ty", "tx", (sx - 0.5).alias("_x"), (sy - 0.5).alias("_y"))
        spots = spots.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in steps for b in steps])))
        x, y = F.floor("_x") + F.col("_d.dx"), F.floor("_y") + F.col("_d.dy")
        kernel = _KERNELS[method]
        weight = kernel(F.abs(F.col("_x") - x)) * kernel(F.abs(F.col("_y") - y))
        spots = spots.select("ty", "tx", x.cast("int").alias("x"), y.cast("int").alias("y"), weight.alias("_w")).filter("_w <> 0")
    known = F.when(F.col("valid"), F.col("_w"))
    mean = F.try_divide(F.sum(known * F.col("value")), F.sum(known))
    out = pixels.join(spots, ["y", "x"]).groupBy("tag", "date", F.col("ty").alias("y"), F.col("tx").alias("x"), "band").agg(mean.alias("value"))
    return out.withColumn("valid", F.col("value").isNotNull())
