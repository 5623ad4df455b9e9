"""Task planner: which dates can be predicted, and from which pairs.

Inputs are tables of dates; each has as many rows as there are images, so sides
that hold pairs are small next to any pixels, but nothing here relies on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument

METHODS = ("starfm", "estarfm", "fitfc")
MODES = ("ignore", "mixed", "all")
HIGH_MODES = ("ignore", "copy", "force")


def check(method: str, singlepair_mode: str, high_mode: str) -> None:
    if method not in METHODS:
        raise InvalidArgument(f"no such method: {method!r}")
    if singlepair_mode not in MODES or high_mode not in HIGH_MODES:
        raise InvalidArgument(f"no such mode: {singlepair_mode!r}, {high_mode!r}")
    if singlepair_mode != "ignore" and method == "estarfm":
        raise InvalidArgument("estarfm needs two pairs; single pairs can't be used")


def pairs(high: DataFrame, low: DataFrame) -> DataFrame:
    return high.join(low, "date").select("date").distinct().orderBy("date")


def low_only(high: DataFrame, low: DataFrame) -> DataFrame:
    return low.join(high, "date", "left_anti").select("date").distinct().orderBy("date")


def task_table(high: DataFrame, low: DataFrame, wanted: DataFrame) -> DataFrame:
    """date, has_high, has_low, predict, pred_case.

    Cases: 0 not asked for; 1 low image only, between pairs; 2 low image only,
    outside; 3 no image; 4 both images; 5 high image only.
    """
    mark = lambda df, name: df.select("date").distinct().withColumn(name, F.lit(True))
    t = mark(high, "has_high").join(mark(low, "has_low"), "date", "full").join(mark(wanted, "predict"), "date", "full")
    t = t.select("date", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_high", "has_low", "predict")])
    both = F.col("has_high") & F.col("has_low")
    # the span of pairs is two numbers: a window over nothing would gather all rows
    span = t.filter(both).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    t = t.crossJoin(F.broadcast(span))
    inside = F.coalesce(F.col("date").between(F.col("_a"), F.col("_b")), F.lit(False))
    case = (
        F.when(~F.col("predict"), 0)
        .when(F.col("has_low") & ~F.col("has_high"), F.when(inside, 1).otherwise(2))
        .when(~F.col("has_low") & ~F.col("has_high"), 3)
        .when(both, 4)
        .otherwise(5)
    )
    return t.withColumn("pred_case", case.cast("int")).drop("_a", "_b").orderBy("date")


def pair_intervals(task: DataFrame) -> DataFrame:
    """Intervals (lo, hi] between pair dates, open at both ends of time: interval_id, lo, hi."""
    dates = task.filter("has_high and has_low").select("date")
    order = Window.orderBy("date")  # one row per pair date
    ids = dates.withColumn("interval_id", F.row_number().over(order)).withColumn("lo", F.lag("date").over(order))
    last = dates.agg(F.max("date").alias("lo"), (F.count("*") + 1).cast("int").alias("interval_id")).filter("lo is not null")
    return ids.select("interval_id", "lo", F.col("date").alias("hi")).unionByName(last.select("interval_id", "lo", F.lit(None).cast("int").alias("hi")))


def with_intervals(task: DataFrame, mode: str = "ignore") -> DataFrame:
    """The task table with interval_id, start_pair, end_pair, interval_start, interval_end, interval_npred."""
    if mode not in MODES:
        raise InvalidArgument(f"no such mode: {mode!r}")
    if mode == "all":
        t = task.withColumn("pred_case", F.when(F.col("pred_case") == 1, 2).otherwise(F.col("pred_case")).cast("int"))
        near = t.select("date").crossJoin(F.broadcast(task.filter("has_high and has_low").select(F.col("date").alias("p"))))
        near = near.groupBy("date").agg(F.min_by("p", F.struct(F.abs(F.col("date") - F.col("p")), F.col("p"))).alias("start_pair"))
        t = t.join(near, "date").withColumn("end_pair", F.col("start_pair")).withColumn("interval_id", F.col("start_pair"))
        cases = (1, 2)
    else:
        cut = F.broadcast(pair_intervals(task))
        hit = (F.col("lo").isNull() | (F.col("date") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("date") <= F.col("hi")))
        t = task.join(cut, hit).withColumn("start_pair", F.coalesce("lo", "hi")).withColumn("end_pair", F.coalesce("hi", "lo")).drop("lo", "hi")
        cases = (1,) if mode == "ignore" else (1, 2)
    own = Window.partitionBy("interval_id")
    asked = F.when(F.col("predict") & F.col("pred_case").isin(*cases), 1).otherwise(0)
    t = t.withColumn("interval_start", F.min("date").over(own) - 1).withColumn("interval_end", F.max("date").over(own)).withColumn("interval_npred", F.sum(asked).over(own))
    return t.select("date", "has_high", "has_low", "predict", "pred_case", "interval_id", "start_pair", "end_pair", "interval_start", "interval_end", "interval_npred").orderBy("date")


def job_table(planned: DataFrame) -> DataFrame:
    """One row per interval with anything to predict."""
    keys = ["interval_id", "start_pair", "end_pair", "interval_start", "interval_end", "interval_npred"]
    return planned.filter("interval_npred > 0").select(*keys).distinct().orderBy("interval_id")


def job_map(planned: DataFrame, mode: str = "ignore") -> DataFrame:
    """Predictions and the pair dates each is made from: date, date1, date3 (null for a single pair)."""
    cases = [1] if mode == "ignore" else [1, 2]
    one = (F.col("start_pair") == F.col("end_pair")) | (F.col("pred_case") == 2)
    return planned.filter(F.col("predict") & F.col("pred_case").isin(*cases)).select("date", F.col("start_pair").alias("date1"), F.when(~one, F.col("end_pair")).alias("date3")).orderBy("date")


def high_dates(planned: DataFrame, mode: str) -> DataFrame:
    """Dates to predict that have a high image (cases 4 and 5), and what to do with them."""
    return planned.filter("pred_case in (4, 5)").select("date", "pred_case", F.lit(mode).alias("action")).filter(F.col("action") != "ignore").orderBy("date")


def copy_high(pixels: DataFrame, dates: DataFrame, high_tag: str) -> DataFrame:
    """High images relabelled as predictions of their own date."""
    return pixels.filter(F.col("tag") == high_tag).join(F.broadcast(dates.select("date")), "date", "left_semi").withColumn("tag", F.lit("predicted"))


def predictions_for(all_dates: DataFrame, pair_dates: DataFrame) -> DataFrame:
    return all_dates.select("date").subtract(pair_dates.select("date")).orderBy("date")
