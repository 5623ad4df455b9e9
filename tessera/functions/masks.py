"""Validity masks: value ranges, bit fields, QA presets and their combination."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.functions.intervals import IntervalSet


def bits(value: Column, positions: list[int]) -> Column:
    """The chosen bits, ascending, moved together at the low end; all of them if none is chosen."""
    if not positions:
        return value
    if min(positions) < 0:
        raise InvalidArgument("bit positions start at 0")
    parts = [F.shiftleft(F.shiftright(value, b).bitwiseAND(1), i) for i, b in enumerate(sorted(set(positions)))]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


@dataclass(frozen=True)
class BitTest:
    """True where the extracted bits lie in ``wanted`` (anything but 0, if None)."""

    positions: tuple[int, ...] = ()
    wanted: IntervalSet | None = None

    def __call__(self, value: Column) -> Column:
        found = bits(value, list(self.positions))
        return found != 0 if self.wanted is None else self.wanted.discrete().contains(found)


#: Which quality codes ask for interpolation.
QA_PRESETS = {
    "modis": BitTest((0, 1, 2), IntervalSet.parse("[1,7]") - IntervalSet.parse("[3,3]")),
    "landsat": BitTest((3, 5, 7), IntervalSet.parse("[1,7]")),
    "fmask-python": BitTest((), IntervalSet.parse("[2,3]")),
    "fmask-matlab": BitTest((), IntervalSet.parse("[2,2] [4,4]")),
}


def range_mask(pixels: DataFrame, valid: IntervalSet, integral: bool = True) -> DataFrame:
    """Mask per band: y, x, band, valid."""
    wanted = valid.discrete() if integral else valid
    return pixels.select("tag", "date", "y", "x", "band", wanted.contains(F.col("value")).alias("valid"))


def single_mask(mask: DataFrame, every: bool = True) -> DataFrame:
    """One mask for all bands: valid if every band is (or if any is)."""
    return mask.groupBy("tag", "date", "y", "x").agg((F.bool_and if every else F.bool_or)("valid").alias("valid"))


def combine(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """AND a mask into pixels; a mask without bands holds for all, a missing cell is invalid."""
    keys = [c for c in ("tag", "date", "y", "x", "band") if c in mask.columns]
    right = mask.withColumnRenamed("valid", "_mask")
    return pixels.join(right, keys, "left").withColumn("valid", F.col("valid") & F.coalesce("_mask", F.lit(False))).drop("_mask")


def pair_mask(pixels: DataFrame, images: list[tuple[str, int]], per_band: bool = True) -> DataFrame:
    """Cells valid in all the images of a pair."""
    wanted = F.lit(False)
    for tag, date in images:
        wanted = wanted | ((F.col("tag") == tag) & (F.col("date") == date))
    keys = ["y", "x", "band"] if per_band else ["y", "x"]
    return pixels.filter(wanted).groupBy(*keys).agg(F.bool_and("valid").alias("valid"))


def not_nodata(value: Column, nodata: float | None) -> Column:
    """NaN or None means that no value stands for missing data."""
    return F.lit(True) if nodata is None or nodata != nodata else value != nodata
