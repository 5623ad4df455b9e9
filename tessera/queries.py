"""One query per operator over the driver's tables, with the same query as SQL."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import arith, color, masks
from tessera.functions.geo import GeoTransform, Rectangle
from tessera.functions.intervals import IntervalSet
from tessera.model import dense_raster, fine_raster, long_form, low_raster
from tessera.operators import aggregates, estarfm, fitfc, interpolation, neighborhood, staarch, starfm, warp
from tessera.plans import planner
from tessera.sources import raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BANDS = ["b0", "b1", "b2"]
#: Added before rounding, in SQL too: an error of summation must not decide how a half is rounded.
NUDGE = 1e-9

FINE = """fine AS (
  SELECT CAST((l_orderkey % 1024) % 32 AS INT) AS x, CAST((l_orderkey % 1024) // 32 AS INT) AS y, CAST(l_linenumber AS INT) AS d,
    CAST(sum(CAST(l_quantity AS BIGINT)) % 256 AS INT) AS b0, CAST(sum(l_partkey) % 256 AS INT) AS b1, CAST(sum(l_suppkey) % 256 AS INT) AS b2,
    CAST(max(l_suppkey) % 256 AS INT) AS qa, bool_or(l_returnflag = 'N') AS ok
  FROM lineitem GROUP BY 1, 2, 3)"""
DENSE = f"""{FINE}, dense AS (
  SELECT g.x, g.y, g.d, f.b0, f.b1, f.b2, f.qa, coalesce(f.ok, false) AS ok
  FROM (SELECT CAST(i % 32 AS INT) AS x, CAST((i // 32) % 32 AS INT) AS y, CAST(i // 1024 + 1 AS INT) AS d FROM range(7168) t(i)) g
  LEFT JOIN fine f ON g.x = f.x AND g.y = f.y AND g.d = f.d)"""
LOW = f"""{DENSE}, low AS (
  SELECT x, y, d, CAST(floor(sum(b0) OVER w / count(b0) OVER w) AS INT) AS b0, CAST(floor(sum(b1) OVER w / count(b1) OVER w) AS INT) AS b1,
    CAST(floor(sum(b2) OVER w / count(b2) OVER w) AS INT) AS b2
  FROM dense WINDOW w AS (PARTITION BY d, x // 4, y // 4))"""
PX = f"""{DENSE}, px AS (
  SELECT d AS date, y, x, band, CAST(v AS DOUBLE) AS value, ok AND v IS NOT NULL AS valid
  FROM (SELECT d, y, x, ok, unnest([0, 1, 2]) AS band, unnest([b0, b1, b2]) AS v FROM dense))"""
EMB = """emb AS (
  SELECT CAST(vec_id % 25 AS INT) AS x, CAST(vec_id // 25 AS INT) AS y, label, """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(7)) + " FROM embeddings)"
RGB = f"""{FINE}, rgb AS (SELECT x, y, d, b0 / 255.0::DOUBLE AS r, b1 / 255.0::DOUBLE AS g, b2 / 255.0::DOUBLE AS b FROM fine)"""
DAYS = """high AS (SELECT DISTINCT CAST(day(ts) AS INT) AS date FROM events WHERE user_id = 3 AND event_type = 'signup'),
low_d AS (SELECT DISTINCT CAST(day(ts) AS INT) AS date FROM events WHERE user_id = 1 AND event_type IN ('click', 'view')),
pred AS (SELECT DISTINCT CAST(day(ts) AS INT) AS date FROM events WHERE user_id = 4)"""
TASK = f"""{DAYS}, pr AS (SELECT h.date FROM high h JOIN low_d l USING (date)), t0 AS (
  SELECT date, h.date IS NOT NULL AS has_high, l.date IS NOT NULL AS has_low, p.date IS NOT NULL AS predict
  FROM (SELECT date FROM high UNION SELECT date FROM low_d UNION SELECT date FROM pred) a
  LEFT JOIN high h USING (date) LEFT JOIN low_d l USING (date) LEFT JOIN pred p USING (date)), task AS (
  SELECT *, CAST(CASE WHEN NOT predict THEN 0
    WHEN has_low AND NOT has_high THEN CASE WHEN date BETWEEN (SELECT min(date) FROM pr) AND (SELECT max(date) FROM pr) THEN 1 ELSE 2 END
    WHEN NOT has_low AND NOT has_high THEN 3 WHEN has_low AND has_high THEN 4 ELSE 5 END AS INT) AS pred_case FROM t0)"""


def _planned_sql(mode: str) -> str:
    if mode == "all":
        base = """t1 AS (SELECT date, has_high, has_low, predict, CAST(CASE pred_case WHEN 1 THEN 2 ELSE pred_case END AS INT) AS pred_case FROM task), pl AS (
          SELECT t1.*, n.p AS interval_id, n.p AS start_pair, n.p AS end_pair FROM t1
          JOIN (SELECT t1.date, arg_min(pr.date, abs(t1.date - pr.date) * 1000 + pr.date) AS p FROM t1, pr GROUP BY t1.date) n USING (date))"""
        cases = "1, 2"
    else:
        base = """iv AS (SELECT CAST(row_number() OVER (ORDER BY date) AS INT) AS interval_id, lag(date) OVER (ORDER BY date) AS lo, date AS hi FROM pr
            UNION ALL SELECT CAST(count(*) + 1 AS INT), max(date), NULL FROM pr HAVING count(*) > 0), pl AS (
          SELECT task.*, interval_id, coalesce(lo, hi) AS start_pair, coalesce(hi, lo) AS end_pair FROM task
          JOIN iv ON (lo IS NULL OR date > lo) AND (hi IS NULL OR date <= hi))"""
        cases = "1" if mode == "ignore" else "1, 2"
    return f"""WITH {TASK}, {base}, planned AS (SELECT date, has_high, has_low, predict, pred_case, interval_id, start_pair, end_pair,
      CAST(min(date) OVER w - 1 AS INT) AS interval_start, max(date) OVER w AS interval_end,
      CAST(sum(CASE WHEN predict AND pred_case IN ({cases}) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS interval_npred
      FROM pl WINDOW w AS (PARTITION BY interval_id))"""


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _px(spark: SparkSession, d: str) -> DataFrame:
    return long_form(dense_raster(spark, d), "high", BANDS)


def _embedding_cells(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select((F.col("vec_id") % 25).cast("int").alias("x"), (F.col("vec_id") / 25).cast("int").alias("y"), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(7)])


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles to six places; adding 0 turns a negative zero into a positive one."""
    return df.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) for c in df.columns if c not in keys])


def _round_sql(pairs: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in pairs.items())


def _dates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("date", F.dayofmonth("ts"))
    pick = lambda c: e.filter(c).select("date").distinct()
    return pick("user_id = 3 and event_type = 'signup'"), pick("user_id = 1 and event_type in ('click', 'view')"), pick("user_id = 4")


def _task(spark: SparkSession, d: str) -> DataFrame:
    return planner.task_table(*_dates(spark, d))


# --- scans ---------------------------------------------------------------------------------------


@query("raster_scan", f"WITH {FINE} SELECT x, y, d, b0, b1, b2, qa, ok FROM fine")
def raster_scan(spark, d):
    return fine_raster(spark, d)


@query("crop_project", f"WITH {FINE} SELECT x, y, d, b0, b2 FROM fine WHERE x >= 4 AND x < 20 AND y >= 8 AND y < 16")
def crop_project(spark, d):
    return fine_raster(spark, d).filter(Rectangle(4, 8, 16, 8).contains(F.col("x"), F.col("y"))).select("x", "y", "d", "b0", "b2")


@query("flip_scan", f"WITH {FINE} SELECT CAST(31 - x AS INT) AS x, CAST(31 - y AS INT) AS y, d, b0 FROM fine")
def flip_scan(spark, d):
    return fine_raster(spark, d).select((31 - F.col("x")).alias("x"), (31 - F.col("y")).alias("y"), "d", "b0")


def _scratch(spark: SparkSession) -> str:
    """A folder for files of a query: the one the cluster shares, if it names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = None if shared is None else shared.removeprefix("file:").replace("//", "/")
    return tempfile.mkdtemp(prefix="tiff-", dir=base)


@query("tiff_scan", f"WITH {PX} SELECT date, CAST(y - 4 AS INT) AS y, CAST(x - 3 AS INT) AS x, band, value FROM px WHERE valid AND x BETWEEN 3 AND 22 AND y BETWEEN 4 AND 19 AND band IN (0, 2)")
def tiff_scan(spark, d):
    """Every image is written as a tiled, compressed GeoTIFF and scanned again: two bands of a window."""
    info = raster.GeoInfo(32, 32, 3, "int16", (-1.0,) * 3)
    paths = raster.write_tiffs(raster.to_tiffs(_px(spark, d), info, "lzw", True, 16), _scratch(spark))
    images = [("high", int(os.path.basename(p).split("_")[1].split(".")[0]), p) for p in paths]
    return raster.read_tiff(spark, images, [0, 2], Rectangle(3, 4, 20, 16)).filter("valid").select("date", "y", "x", "band", "value")


@query("densify", f"WITH {DENSE} SELECT * FROM dense")
def densify(spark, d):
    return dense_raster(spark, d)


@query("low_resolution", f"WITH {LOW} SELECT * FROM low")
def low_resolution(spark, d):
    return low_raster(dense_raster(spark, d)).drop("ok")


@query("split_bands", f"WITH {PX} SELECT * FROM px")
def split_bands(spark, d):
    return _px(spark, d).drop("tag")


@query("merge_bands", f"WITH {PX} SELECT date, y, x, max(value) FILTER (band = 0) AS b0, max(value) FILTER (band = 1) AS b1, max(value) FILTER (band = 2) AS b2 FROM px GROUP BY 1, 2, 3")
def merge_bands(spark, d):
    return _px(spark, d).groupBy("date", "y", "x").agg(*[F.max(F.when(F.col("band") == i, F.col("value"))).alias(f"b{i}") for i in range(3)])


# --- masks ---------------------------------------------------------------------------------------
_RANGE = IntervalSet.parse("[10,100] (150,200)")
_IN = "value IS NOT NULL AND (value BETWEEN 10 AND 100 OR value BETWEEN 151 AND 199)"


@query("interval_mask_multi", f"WITH {PX} SELECT date, y, x, band, {_IN} AS valid FROM px")
def interval_mask_multi(spark, d):
    return masks.range_mask(_px(spark, d), _RANGE).drop("tag")


@query("interval_mask_single", f"WITH {PX} SELECT date, y, x, bool_and({_IN}) AS every, bool_or({_IN}) AS anyone FROM px GROUP BY 1, 2, 3")
def interval_mask_single(spark, d):
    m = masks.range_mask(_px(spark, d), _RANGE)
    return m.groupBy("date", "y", "x").agg(F.bool_and("valid").alias("every"), F.bool_or("valid").alias("anyone"))


@query("mask_and", f"WITH {PX} SELECT date, y, x, band, value, valid AND {_IN} AS valid FROM px")
def mask_and(spark, d):
    p = _px(spark, d)
    return masks.combine(p, masks.range_mask(p, _RANGE)).select("date", "y", "x", "band", "value", "valid")


@query("pair_mask", f"WITH {PX} SELECT y, x, band, bool_and(valid) AS valid FROM px WHERE date IN (1, 7) GROUP BY 1, 2, 3")
def pair_mask(spark, d):
    return masks.pair_mask(_px(spark, d), [("high", 1), ("high", 7)])


@query("bit_extract_mask", f"WITH {FINE} SELECT x, y, d, CAST(((qa >> 1) & 1) + (((qa >> 4) & 1) << 1) + (((qa >> 6) & 1) << 2) AS INT) AS bits, ((qa >> 1) & 1) + (((qa >> 4) & 1) << 1) + (((qa >> 6) & 1) << 2) BETWEEN 2 AND 5 AS hit FROM fine")
def bit_extract_mask(spark, d):
    t = masks.BitTest((6, 1, 4), IntervalSet.parse("[2,5]"))
    return fine_raster(spark, d).select("x", "y", "d", masks.bits(F.col("qa"), [6, 1, 4]).alias("bits"), t(F.col("qa")).alias("hit"))


def _qa(name: str, sql: str):
    @query(f"qa_{name.replace('-', '_')}", f"WITH {FINE} SELECT x, y, d, {sql} AS flag FROM fine")
    def run(spark, d):
        return fine_raster(spark, d).select("x", "y", "d", masks.QA_PRESETS[name](F.col("qa")).alias("flag"))


_qa("modis", "(qa & 7) BETWEEN 1 AND 7 AND (qa & 7) <> 3")
_qa("landsat", "((qa >> 3) & 1) + (((qa >> 5) & 1) << 1) + (((qa >> 7) & 1) << 2) BETWEEN 1 AND 7")
_qa("fmask-python", "qa IN (2, 3)")
_qa("fmask-matlab", "qa IN (2, 4)")


@query("nodata_predicate", f"WITH {PX} SELECT date, y, x, band, value <> 77 AS valid FROM px WHERE value IS NOT NULL")
def nodata_predicate(spark, d):
    return _px(spark, d).filter("value is not null").select("date", "y", "x", "band", masks.not_nodata(F.col("value"), 77.0).alias("valid"))


@query("prediction_mask", f"WITH {PX}, p AS (SELECT y, x, band, bool_and(valid) AS v FROM px WHERE date IN (1, 7) GROUP BY 1, 2, 3) SELECT px.date, y, x, band, p.v AND {_IN} AS valid FROM px JOIN p USING (y, x, band) WHERE px.date BETWEEN 2 AND 6")
def prediction_mask(spark, d):
    p = _px(spark, d)
    pair = masks.pair_mask(p, [("high", 1), ("high", 7)])
    now = masks.range_mask(p.filter("date between 2 and 6"), _RANGE)
    return masks.combine(now, pair).select("date", "y", "x", "band", "valid")


# --- cell arithmetic -----------------------------------------------------------------------------
def _cells(name: str, sql: str, fn):
    @query(name, f"WITH {FINE} SELECT x, y, d, CAST({sql} AS DOUBLE) AS value FROM fine")
    def run(spark, d):
        return fine_raster(spark, d).select("x", "y", "d", fn(F.col("b0"), F.col("b1"), F.col("b2")).cast("double").alias("value"))


_cells("cell_add_sat", "least(b0 + b1, 255)", lambda a, b, c: arith.add(a, b, "uint8"))
_cells("cell_sub_sat", "greatest(b0 - b1, 0)", lambda a, b, c: arith.subtract(a, b, "uint8"))
_cells("cell_mul_sat", "least(b0 * b1, 32767)", lambda a, b, c: arith.multiply(a, b, "int16"))
_cells("cell_div", "CASE WHEN b1 % 16 = 0 THEN 0 ELSE round_even(b0 / (b1 % 16), 0) END", lambda a, b, c: arith.divide(a, b % 16, "uint8"))
_cells("cell_absdiff", "abs(b0 - b1)", lambda a, b, c: arith.absdiff(a, b))
_cells("cell_abs", "least(abs(b0 - 200), 127)", lambda a, b, c: arith.absolute(a - 200, "int8"))
_cells("cell_min", "CASE WHEN b2 > 100 THEN least(b0, b1) ELSE b0 END", lambda a, b, c: arith.minimum(a, b, c > 100))
_cells("cell_max", "greatest(b0, b1)", lambda a, b, c: arith.maximum(a, b))
_cells("cell_bitwise", "xor(b0 & b1, b2) | 1", lambda a, b, c: arith.bitwise("or", arith.bitwise("xor", arith.bitwise("and", a, b), c), F.lit(1)))
_cells("masked_set", "CASE WHEN b1 < 50 THEN 7 ELSE b0 END", lambda a, b, c: arith.put(a, 7, b < 50))
_cells("copy_values_masked", "CASE WHEN b1 < 50 THEN b2 ELSE b0 END", lambda a, b, c: arith.put(a, c, b < 50))
_cells("convert_type", "least(greatest(round_even((b0 - 100) / 2.0, 0), -128), 127)", lambda a, b, c: arith.convert((a - 100) / 2.0, "int8"))


# --- aggregates ----------------------------------------------------------------------------------
@query("mean_std", f"WITH {PX} SELECT date, band, {_round_sql({'mean': 'coalesce(avg(value) FILTER (valid), 0)', 'std': 'coalesce(stddev_pop(value) FILTER (valid), 0)'})} FROM px GROUP BY 1, 2")
def mean_std(spark, d):
    return _rounded(aggregates.mean_std(_px(spark, d)).drop("tag"), "date", "band")


@query("minmax_loc", f"""WITH {PX}, v AS (SELECT *, y * 100 + x AS p FROM px WHERE valid) SELECT date, band, min(value) AS low, CAST(arg_min(p, value * 10000 + p) // 100 AS INT) AS low_y, CAST(arg_min(p, value * 10000 + p) % 100 AS INT) AS low_x,
  max(value) AS high, CAST(arg_min(p, -value * 10000 + p) // 100 AS INT) AS high_y, CAST(arg_min(p, -value * 10000 + p) % 100 AS INT) AS high_x FROM v GROUP BY 1, 2""")
def minmax_loc(spark, d):
    m = aggregates.min_max_places(_px(spark, d))
    return m.select("date", "band", "low", F.col("at_low.y").alias("low_y"), F.col("at_low.x").alias("low_x"), "high", F.col("at_high.y").alias("high_y"), F.col("at_high.x").alias("high_x"))


@query("unique_count", f"WITH {PX} SELECT date, band, value, count(*) AS n FROM px WHERE valid GROUP BY 1, 2, 3")
def unique_count(spark, d):
    return aggregates.unique_counts(_px(spark, d)).drop("tag")


@query("histogram_nodata", f"WITH {PX} SELECT CAST(i AS DOUBLE) AS value FROM range(0, 256) t(i) WHERE i NOT IN (SELECT value FROM px WHERE valid AND value <= 255 AND band = 0 AND date = 1 AND y < 8)")
def histogram_nodata(spark, d):
    return aggregates.free_values(_px(spark, d).filter("band = 0 and date = 1 and y < 8"), 0, 255)


@query("image_counts", f"WITH {PX} SELECT date, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM px GROUP BY 1")
def image_counts(spark, d):
    return _px(spark, d).groupBy("date").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


# --- planner -------------------------------------------------------------------------------------
@query("pairs_inner", f"WITH {TASK} SELECT date FROM pr")
def pairs_inner(spark, d):
    return planner.pairs(*_dates(spark, d)[:2])


@query("low_only_anti", f"WITH {DAYS} SELECT date FROM low_d WHERE date NOT IN (SELECT date FROM high)")
def low_only_anti(spark, d):
    return planner.low_only(*_dates(spark, d)[:2])


@query("task_table", f"WITH {TASK} SELECT date, has_high, has_low, predict FROM task")
def task_table(spark, d):
    return _task(spark, d).drop("pred_case")


@query("pred_case", f"WITH {TASK} SELECT date, pred_case FROM task")
def pred_case(spark, d):
    return _task(spark, d).select("date", "pred_case")


def _intervals(mode: str, name: str):
    @query(name, _planned_sql(mode) + " SELECT * FROM planned")
    def run(spark, d):
        return planner.with_intervals(_task(spark, d), mode)


_intervals("ignore", "intervals_ignore")
_intervals("mixed", "intervals_mixed")
_intervals("all", "intervals_all_nearest")


@query("job_table", _planned_sql("mixed") + " SELECT DISTINCT interval_id, start_pair, end_pair, interval_start, interval_end, interval_npred FROM planned WHERE interval_npred > 0")
def job_table(spark, d):
    return planner.job_table(planner.with_intervals(_task(spark, d), "mixed"))


@query("job_map", _planned_sql("mixed") + " SELECT date, start_pair AS date1, CASE WHEN start_pair <> end_pair AND pred_case = 1 THEN end_pair END AS date3 FROM planned WHERE predict AND pred_case IN (1, 2)")
def job_map(spark, d):
    return planner.job_map(planner.with_intervals(_task(spark, d), "mixed"), "mixed")


@query("self_predict_force", f"WITH {TASK} SELECT date, pred_case, 'force' AS action FROM task WHERE pred_case IN (4, 5)")
def self_predict_force(spark, d):
    return planner.high_dates(_task(spark, d), "force")


@query("copy_high", f"WITH {PX} SELECT 'predicted' AS tag, date, y, x, band, value, valid FROM px WHERE date IN (2, 3)")
def copy_high(spark, d):
    return planner.copy_high(_px(spark, d), spark.createDataFrame([(2,), (3,)], "date int"), "high").select("tag", "date", "y", "x", "band", "value", "valid")


def _date_sets(name: str, sql: str, fn):
    @query(name, f"WITH {DAYS} {sql}")
    def run(spark, d):
        high, low, _ = _dates(spark, d)
        return fn(high, low)


_date_sets("date_union", "SELECT date FROM high UNION SELECT date FROM low_d", lambda a, b: a.union(b).distinct())
_date_sets("date_intersection", "SELECT date FROM high INTERSECT SELECT date FROM low_d", lambda a, b: a.intersect(b))
_date_sets("date_difference", "SELECT date FROM low_d EXCEPT SELECT date FROM high", lambda a, b: b.subtract(a))


@query("prediction_dates", f"WITH {TASK} SELECT date FROM task WHERE date NOT IN (SELECT date FROM pr)")
def prediction_dates(spark, d):
    high, low, _ = _dates(spark, d)
    return planner.predictions_for(_task(spark, d), planner.pairs(high, low))


# --- temporal interpolation ----------------------------------------------------------------------
def _interp_sql(flag: str, valid: str, invalid_mode: bool, limit: int = 3) -> str:
    ask = f"coalesce({flag}, false)" + (f" OR NOT ({valid})" if invalid_mode else "")
    ok = "true" if invalid_mode else valid
    return f"""WITH {PX}, a AS (SELECT *, bool_or({ask}) OVER (PARTITION BY date, y, x) AS ask, {ok} AS good FROM px),
    s AS (SELECT *, CASE WHEN NOT ask AND good AND value IS NOT NULL THEN date END AS sd, CASE WHEN NOT ask AND good THEN value END AS sv FROM a),
    j AS (SELECT *, max(sd) OVER (PARTITION BY y, x, band ORDER BY date RANGE BETWEEN {limit} PRECEDING AND 1 PRECEDING) AS ld,
      min(sd) OVER (PARTITION BY y, x, band ORDER BY date RANGE BETWEEN 1 FOLLOWING AND {limit} FOLLOWING) AS rd FROM s),
    k AS (SELECT j.*, l.sv AS lv, r.sv AS rv FROM j LEFT JOIN s l ON l.y = j.y AND l.x = j.x AND l.band = j.band AND l.date = j.ld
      LEFT JOIN s r ON r.y = j.y AND r.x = j.x AND r.band = j.band AND r.date = j.rd),
    f AS (SELECT *, CASE WHEN ld IS NOT NULL AND rd IS NOT NULL THEN least(greatest(round_even(lv + (date - ld) * (rv - lv) / (rd - ld), 0), 0), 255) ELSE coalesce(lv, rv) END AS fill FROM k),
    o AS (SELECT date, y, x, band, value AS v0, fill, CAST(CASE WHEN NOT good AND NOT ask THEN 0 WHEN NOT ask THEN 128 WHEN fill IS NULL THEN 64 ELSE 192 END AS SMALLINT) AS state FROM f),
    r AS (SELECT date, y, x, band, CASE state WHEN 192 THEN fill WHEN 128 THEN v0 ELSE v0 END AS value, state FROM o)"""


_LOW_FLAG = IntervalSet.parse("[200,inf)")
_INTERP = interpolation.InterpolationOptions(limit_days=3, interp_invalid=False, dtype="uint8")


@query("interp_linear", _interp_sql("value >= 200", "valid", False) + " SELECT * FROM r")
def interp_linear(spark, d):
    return interpolation.interpolate(_px(spark, d), _LOW_FLAG.contains(F.col("value")), _INTERP).drop("tag")


@query("interp_pixelstate", _interp_sql("value >= 200", "valid", False) + " SELECT date, y, x, max(state) AS most, min(state) AS least FROM r GROUP BY 1, 2, 3")
def interp_pixelstate(spark, d):
    r = interpolation.interpolate(_px(spark, d), _LOW_FLAG.contains(F.col("value")), _INTERP)
    return r.groupBy("date", "y", "x").agg(F.max("state").alias("most"), F.min("state").alias("least"))


@query("interp_invalid_mode", _interp_sql("value >= 200", "valid", True) + " SELECT * FROM r")
def interp_invalid_mode(spark, d):
    o = interpolation.InterpolationOptions(limit_days=3, interp_invalid=True, dtype="uint8")
    return interpolation.interpolate(_px(spark, d), _LOW_FLAG.contains(F.col("value")), o).drop("tag")


@query("interp_stats", _interp_sql("value >= 200", "valid", False) + " SELECT date, count(*) AS n_values, count(*) FILTER (state = 0) AS n_nodata, count(*) FILTER (state IN (64, 192)) AS n_interp_before, count(*) FILTER (state = 64) AS n_interp_after FROM r GROUP BY 1")
def interp_stats(spark, d):
    return interpolation.statistics(interpolation.interpolate(_px(spark, d), _LOW_FLAG.contains(F.col("value")), _INTERP)).drop("tag")


@query("interp_qa_layer", f"WITH {DENSE} SELECT d AS date, y, x, coalesce((qa & 7) BETWEEN 1 AND 7 AND (qa & 7) <> 3, false) OR coalesce(d = 2 AND x < 4, false) AS flag FROM dense")
def interp_qa_layer(spark, d):
    dense = dense_raster(spark, d)
    own = dense.select(F.lit("high").alias("tag"), F.col("d").alias("date"), "y", "x", masks.QA_PRESETS["modis"](F.col("qa")).alias("flag"))
    shared = dense.filter("d = 2").select(F.lit("").alias("tag"), F.col("d").alias("date"), "y", "x", (F.col("x") < 4).alias("flag"))
    cells = dense.select(F.lit("high").alias("tag"), F.col("d").alias("date"), "y", "x")
    return interpolation.layer_flags(cells, own.unionByName(shared)).drop("tag")


# --- windows in space ----------------------------------------------------------------------------
@query("box_sum", f"WITH {DENSE} SELECT a.x, a.y, a.d, CAST(sum(b.b0) AS BIGINT) AS s, count(b.b0) AS n FROM dense a JOIN dense b ON a.d = b.d AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY 1, 2, 3")
def box_sum(spark, d):
    one = F.when(F.col("b0").isNotNull(), 1).otherwise(0)
    return neighborhood.box_sum(dense_raster(spark, d), 2, {"s": F.col("b0"), "n": one}, ["d"]).select("x", "y", "d", "s", "n")


@query("window_std_tol", f"WITH {DENSE} SELECT a.x, a.y, a.d, round(sqrt(greatest(sum(CAST(b.b0 AS DOUBLE) * b.b0) / count(b.b0) - (sum(b.b0) / count(b.b0)) * (sum(b.b0) / count(b.b0)), 0)) * 2 / 4, 6) + 0.0 AS tol FROM dense a JOIN dense b ON a.d = b.d AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY 1, 2, 3")
def window_std_tol(spark, d):
    v, one = F.col("b0").cast("double"), F.when(F.col("b0").isNotNull(), 1).otherwise(0)
    s = neighborhood.box_sum(dense_raster(spark, d), 2, {"s": v, "q": v * v, "n": one}, ["d"])
    mean = F.col("s") / F.col("n")
    return s.select("x", "y", "d", (F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) * 2 / 4, 6) + 0.0).alias("tol"))


@query("distance_weights", "SELECT CAST(a.i AS INT) AS dx, CAST(b.i AS INT) AS dy, round(1 + 2 * sqrt(a.i * a.i + b.i * b.i) / 7, 6) AS weight FROM range(-3, 4) a(i), range(-3, 4) b(i)")
def distance_weights(spark, d):
    return neighborhood.offsets(spark, 3).select("dx", "dy", F.round("weight", 6).alias("weight"))


@query("tile_halo", f"WITH {FINE} SELECT ty, tx, d, count(*) AS n, CAST(sum(b0) AS BIGINT) AS s FROM fine, (SELECT unnest([0, 1, 2, 3]) AS ty) a, (SELECT unnest([0, 1, 2, 3]) AS tx) b WHERE y BETWEEN ty * 8 - 2 AND ty * 8 + 9 AND x BETWEEN tx * 8 - 2 AND tx * 8 + 9 GROUP BY 1, 2, 3")
def tile_halo(spark, d):
    return neighborhood.tiles(fine_raster(spark, d), 2, 8).filter("ty between 0 and 3 and tx between 0 and 3").groupBy("ty", "tx", "d").agg(F.count("*").alias("n"), F.sum("b0").alias("s"))


@query("bilinear_shift", f"""WITH {DENSE} SELECT a.x, a.y, a.d, a.b0 * 0.375::DOUBLE + b.b0 * 0.125::DOUBLE + c.b0 * 0.375::DOUBLE + e.b0 * 0.125::DOUBLE AS value FROM dense a
  LEFT JOIN dense b ON b.d = a.d AND b.x = a.x + 1 AND b.y = a.y LEFT JOIN dense c ON c.d = a.d AND c.x = a.x AND c.y = a.y + 1 LEFT JOIN dense e ON e.d = a.d AND e.x = a.x + 1 AND e.y = a.y + 1""")
def bilinear_shift(spark, d):
    c = dense_raster(spark, d).select("x", "y", "d", F.col("b0").cast("double").alias("v"))
    right = neighborhood.neighbours(c, 1, 0, ["v"], ["d"]).withColumn("row", F.col("v") * 0.75 + F.col("n_v") * 0.25).select("x", "y", "d", "row")
    below = neighborhood.neighbours(right, 0, 1, ["row"], ["d"])
    return below.select("x", "y", "d", (F.col("row") * 0.5 + F.col("n_row") * 0.5).alias("value"))


def _warp(method: str, sql: str, places: int = 6):
    @query(f"warp_{method}", f"WITH {PX}, t AS (SELECT CAST(i % 10 AS INT) AS tx, CAST(i // 10 AS INT) AS ty FROM range(100) r(i)), c AS (SELECT *, (tx + 0.5::DOUBLE) * 3 + 1 AS sx, (ty + 0.5::DOUBLE) * 2.5::DOUBLE + 2 AS sy FROM t) {sql}")
    def run(spark, d):
        out = warp.warp(_px(spark, d), GeoTransform(), GeoTransform(1.0, 3.0, 0.0, 2.0, 0.0, 2.5), 10, 10, method)
        return out.filter("value is not null").select("date", "y", "x", "band", (F.round(F.col("value") + NUDGE, places) + 0.0).alias("value"))


_warp("nearest", "SELECT px.date, ty AS y, tx AS x, band, round(value + 1e-9, 6) + 0.0 AS value FROM c JOIN px ON px.x = floor(sx) AND px.y = floor(sy) WHERE valid")
_warp("bilinear", """, n AS (SELECT c.ty, c.tx, floor(sx - 0.5) + a.i AS x, floor(sy - 0.5) + b.i AS y,
  CASE a.i WHEN 1 THEN sx - 0.5 - floor(sx - 0.5) ELSE 1 - (sx - 0.5 - floor(sx - 0.5)) END * CASE b.i WHEN 1 THEN sy - 0.5 - floor(sy - 0.5) ELSE 1 - (sy - 0.5 - floor(sy - 0.5)) END AS w FROM c, range(2) a(i), range(2) b(i))
  SELECT px.date, ty AS y, tx AS x, band, round(sum(w * value) / sum(w) + 1e-9, 6) + 0.0 AS value FROM n JOIN px ON px.x = n.x AND px.y = n.y WHERE valid AND w > 0 GROUP BY 1, 2, 3, 4""")


_CONV = "CASE WHEN t <= 1 THEN 1.5::DOUBLE * t * t * t - 2.5::DOUBLE * t * t + 1 WHEN t < 2 THEN -0.5::DOUBLE * t * t * t + 2.5::DOUBLE * t * t - 4 * t + 2 ELSE 0 END"
_SPLI = "CASE WHEN t <= 1 THEN (4 - 6 * t * t + 3 * t * t * t) / 6.0 WHEN t < 2 THEN (2 - t) * (2 - t) * (2 - t) / 6.0 ELSE 0 END"
for _name, _kernel in (("cubic", _CONV), ("cubic_spline", _SPLI)):
    _k = lambda e, k=_kernel: f"(SELECT {k} FROM (SELECT abs({e}) AS t))"
    _warp(_name, f""", n AS (SELECT c.ty, c.tx, floor(sx - 0.5) + a.i AS x, floor(sy - 0.5) + b.i AS y, {_k('sx - 0.5 - floor(sx - 0.5) - a.i')} * {_k('sy - 0.5 - floor(sy - 0.5) - b.i')} AS w FROM c, range(-1, 3) a(i), range(-1, 3) b(i))
  SELECT px.date, ty AS y, tx AS x, band, round(sum(w * value) / sum(w) + 1e-9, 4) + 0.0 AS value FROM n JOIN px ON px.x = n.x AND px.y = n.y WHERE valid AND w <> 0 GROUP BY 1, 2, 3, 4""", 4)


# --- fusion --------------------------------------------------------------------------------------
def _aligned(spark: SparkSession, d: str, double: bool) -> DataFrame:
    """Rows per pred_date (2 to 6), y, x and band of the pair dates 1 and 7."""
    high, low = dense_raster(spark, d), low_raster(dense_raster(spark, d))
    hp, lp = long_form(high, "high", BANDS), long_form(low, "low", BANDS)
    pick = lambda p, day, name: p.filter(F.col("date") == day).select("y", "x", "band", F.col("value").alias(name), F.col("valid").alias(f"ok_{name}"))
    pair = pick(hp, 1, "h1").join(pick(lp, 1, "l1"), ["y", "x", "band"])
    if double:
        pair = pair.join(pick(hp, 7, "h3"), ["y", "x", "band"]).join(pick(lp, 7, "l3"), ["y", "x", "band"])
    ok = F.col("h1").isNotNull() & F.col("l1").isNotNull()
    if double:
        ok = ok & F.col("h3").isNotNull() & F.col("l3").isNotNull()
    now = lp.filter("date between 2 and 6").select(F.col("date").alias("pred_date"), "y", "x", "band", F.col("value").alias("l2"))
    return now.join(pair, ["y", "x", "band"]).withColumn("ok", ok & F.col("l2").isNotNull())


_LOWPX = f"""{LOW}, hp AS (SELECT d, y, x, unnest([0, 1, 2]) AS band, CAST(unnest([b0, b1, b2]) AS DOUBLE) AS v FROM dense),
lp AS (SELECT d, y, x, unnest([0, 1, 2]) AS band, CAST(unnest([b0, b1, b2]) AS DOUBLE) AS v FROM low),
al AS (SELECT n.d AS pred_date, n.y, n.x, n.band, n.v AS l2, h1.v AS h1, l1.v AS l1, h3.v AS h3, l3.v AS l3 FROM lp n
  JOIN hp h1 ON h1.d = 1 AND (h1.y, h1.x, h1.band) = (n.y, n.x, n.band) JOIN lp l1 ON l1.d = 1 AND (l1.y, l1.x, l1.band) = (n.y, n.x, n.band)
  JOIN hp h3 ON h3.d = 7 AND (h3.y, h3.x, h3.band) = (n.y, n.x, n.band) JOIN lp l3 ON l3.d = 7 AND (l3.y, l3.x, l3.band) = (n.y, n.x, n.band)
  WHERE n.d BETWEEN 2 AND 6)"""


def _starfm_sql(double: bool, strict: bool = False, log: float = 0.0, copy: bool = False, also: str = "true", whole: bool = True, radius: int = 2) -> str:
    """Offset self-join of the same formulas; 8 classes, 8-bit values if ``whole``."""
    ks = (1, 3) if double else (1,)
    side = 2 * radius + 1
    ok = f"{also} AND " + " AND ".join(f"h{k} IS NOT NULL AND l{k} IS NOT NULL" for k in ks) + " AND l2 IS NOT NULL"
    sdt, sds = 2**0.5, 2**0.5
    sc = (sdt**2 + sds**2) ** 0.5
    sat = lambda e: f"least(greatest(round_even({e}, 0), 0), 255)" if whole else e
    per = ", ".join(f"abs(l{k} - h{k}) AS s{k}, abs(l{k} - l2) AS t{k}, {sat(f'h{k} + l2 - l{k}')} AS lv{k}, stddev_pop(h{k}) OVER (PARTITION BY pred_date, band) * 2 / 8 AS tol{k}" for k in ks)
    least = lambda es: f"least({', '.join(es)})" if len(es) > 1 else es[0]
    dtc, dsc = sat(least([f"t{k} + {sdt!r}" for k in ks])), sat(least([f"s{k} + {sds!r}" for k in ks]))
    dist = "(1 + 2 * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / {side})".replace("{side}", str(side))
    parts = []
    for k in ks:
        t = f"b.t{k}" if double else "0"
        if log:
            w = f"1 / (ln(2 + {t} * {log}) * ln(2 + b.s{k} * {log}) * {dist})"
        else:
            w = f"CASE WHEN (1 + {t}) * (1 + b.s{k}) >= {sc!r} THEN 1 / ({dist} * ((1 + {t}) * (1 + b.s{k}))) ELSE 1 END"
        test = f"abs(a.h{k} - b.h{k}) < a.tol{k} AND (b.t{k} < a.dtc {'AND' if strict else 'OR'} b.s{k} < a.dsc)"
        parts.append((f"CASE WHEN {test} THEN {w} ELSE 0 END", f"b.lv{k}"))
    ws, wv = " + ".join(p for p, _ in parts), " + ".join(f"({p}) * {v}" for p, v in parts)
    mean = " + ".join(f"any_value(a.lv{k})" for k in ks)
    value = f"CASE WHEN sum({ws}) > 0 THEN sum({wv}) / sum({ws}) ELSE ({mean}) / {len(ks)} END"
    zero = ""
    if copy:
        zero = "CASE " + ("WHEN any_value(a.t1) = 0 AND any_value(a.t3) = 0 THEN (any_value(a.h1) + any_value(a.h3)) / 2 WHEN any_value(a.t3) = 0 THEN any_value(a.h3) " if double else "") + "WHEN any_value(a.t1) = 0 THEN any_value(a.h1) " + " ".join(f"WHEN any_value(a.s{k}) = 0 THEN any_value(a.l2)" for k in ks) + f" ELSE {value} END"
    return f"""WITH {_LOWPX}, g AS (SELECT *, {per} FROM al WHERE {ok}), c AS (SELECT *, {dtc} AS dtc, {dsc} AS dsc FROM g)
    SELECT a.pred_date, a.y, a.x, a.band, round({zero or value} + 1e-9, 4) + 0.0 AS value FROM c a JOIN c b ON a.pred_date = b.pred_date AND a.band = b.band AND b.x BETWEEN a.x - {radius} AND a.x + {radius} AND b.y BETWEEN a.y - {radius} AND a.y + {radius}
    GROUP BY 1, 2, 3, 4"""


def _starfm(name: str, double: bool, **options):
    sql = {"strict": options.get("strict", False), "log": options.get("log_scale", 0.0), "copy": options.get("copy_zero", False)}

    @query(name, _starfm_sql(double, **sql))
    def run(spark, d):
        o = starfm.StarfmOptions(window=5, classes=8, tile=16, **options)
        out = starfm.predict(_aligned(spark, d, double), o, double, cut=False)
        return out.filter("value is not null").select("pred_date", "y", "x", "band", (F.round(F.col("value") + NUDGE, 4) + 0.0).alias("value"))


_starfm("starfm_single", False)
_starfm("starfm_double", True)
_starfm("starfm_strict", True, strict=True)
_starfm("starfm_logscale", True, log_scale=1.0)
_starfm("starfm_copyzero", True, copy_zero=True)


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of high images of the dates 1 and 7 and of all low images; a cell without a value is invalid."""
    high, low = dense_raster(spark, d), low_raster(dense_raster(spark, d))
    p = long_form(high.filter("d in (1, 7)"), "high", BANDS).unionByName(long_form(low, "low", BANDS))
    return p.withColumn("valid", F.col("value").isNotNull())


_MASKED = "(x + 2 * y) % 5 <> 0 AND " + " AND ".join([*(f"{h} > 20" for h in ("h1", "h3")), *(f"{v} BETWEEN 5 AND 200 AND {v} <> 77" for v in ("l1", "l3", "l2"))])


@query("starfm_job_masked", _starfm_sql(True, also=_MASKED, whole=False))
def starfm_job_masked(spark, d):
    """A job as users call it: a mask image, ranges and missing values narrow what is used."""
    p = _images(spark, d)
    mask = dense_raster(spark, d).filter("d = 1").select("y", "x", ((F.col("x") + 2 * F.col("y")) % 5 != 0).alias("valid"))
    job = api.JobMasks((mask,), high_ranges=[("invalid", IntervalSet.parse("[0,20]"))], low_ranges=[("valid", IntervalSet.parse("[5,200]"))], nodata={"low": 77.0})
    o = starfm.StarfmOptions(window=5, classes=8, tile=16, dtype="float64", spectral_uncertainty=1.0, temporal_uncertainty=1.0)
    out, _ = api.starfm_job(p, [2, 3, 4, 5, 6], o, 1, 7, job_masks=job, output_masks=True)
    return out.filter("valid").select(F.col("date").alias("pred_date"), "y", "x", "band", (F.round(F.col("value") + NUDGE, 4) + 0.0).alias("value"))


@query("job_output_masks", f"WITH {_LOWPX} SELECT pred_date, y, x, band, coalesce({_MASKED}, false) AS valid FROM al")
def job_output_masks(spark, d):
    """The mask of each prediction of that job."""
    mask = dense_raster(spark, d).filter("d = 1").select("y", "x", ((F.col("x") + 2 * F.col("y")) % 5 != 0).alias("valid"))
    job = api.JobMasks((mask,), high_ranges=[("invalid", IntervalSet.parse("[0,20]"))], low_ranges=[("valid", IntervalSet.parse("[5,200]"))], nodata={"low": 77.0})
    _, masks_ = api.starfm_job(_images(spark, d), [2, 3, 4, 5, 6], starfm.StarfmOptions(window=5), 1, 7, job_masks=job, output_masks=True)
    return masks_.select(F.col("date").alias("pred_date"), "y", "x", "band", "valid")


@query("starfm_wide_window", _starfm_sql(False, whole=False, radius=25).replace("n.d BETWEEN 2 AND 6", "n.d = 4"))
def starfm_wide_window(spark, d):
    """The default window over tiles smaller than it, so every neighbour search crosses seams."""
    o = starfm.StarfmOptions(window=51, classes=8, tile=16, dtype="float64", spectral_uncertainty=1.0, temporal_uncertainty=1.0)
    out = api.starfm_job(_images(spark, d), [4], o, 1, double=False)
    return out.filter("valid").select(F.col("date").alias("pred_date"), "y", "x", "band", (F.round(F.col("value") + NUDGE, 4) + 0.0).alias("value"))


def _regressed(k: int = 1, whole: bool = True) -> str:
    """Regression of the low image of the pair h{k}, l{k}; 8-bit values if ``whole``."""
    mapped = f"round(ga * h{k} + gb, 9)"
    frm = f"least(greatest(round_even({mapped}, 0), 0), 255)" if whole else mapped
    return f"""{_LOWPX}, v AS (SELECT * FROM al WHERE h{k} IS NOT NULL AND l{k} IS NOT NULL AND l2 IS NOT NULL),
 m AS (SELECT a.pred_date, a.y, a.x, a.band, any_value(a.h{k}) AS h1, any_value(a.l{k}) AS l1, any_value(a.l2) AS l2, count(*)::DOUBLE AS n, sum(b.l{k}) AS sx, sum(b.l2) AS sy, sum(b.l{k} * b.l{k}) AS sxx, sum(b.l{k} * b.l2) AS sxy
   FROM v a JOIN v b ON a.pred_date = b.pred_date AND a.band = b.band AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY 1, 2, 3, 4),
 r AS (SELECT *, abs(n * sxx - sx * sx) < 1e-14 AS flat, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS ga FROM m), q AS (SELECT *, (sy - ga * sx) / n AS gb FROM r),
 reg AS (SELECT pred_date, y, x, band, h1, CASE WHEN flat THEN h1 ELSE {frm.replace(f'h{k}', 'h1')} END AS frm, CASE WHEN flat THEN l2 - l1 ELSE l2 - (ga * l1 + gb) END AS residual FROM q)"""


_REGRESSED = _regressed()
_CUBIC = ", ".join(f"({o}, {i}, {w!r}::DOUBLE)" for o, i, w in fitfc.cubic_weights(8, 32))


@query("fitfc_regression", f"WITH {_REGRESSED} SELECT pred_date, y, x, band, round(frm, 6) + 0.0 AS frm, round(residual, 6) + 0.0 AS residual FROM reg")
def fitfc_regression(spark, d):
    r = fitfc.regression(_aligned(spark, d, False), fitfc.FitFCOptions(window=7))
    return _rounded(r.filter("ok").select("pred_date", "y", "x", "band", "frm", "residual"), "pred_date", "y", "x", "band")


@query("fitfc_residual_downscale", f"WITH {_LOWPX} SELECT pred_date, band, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, round(avg(l2 - l1), 6) + 0.0 AS residual FROM al GROUP BY 1, 2, 3, 4")
def fitfc_residual_downscale(spark, d):
    r = _aligned(spark, d, False).select("pred_date", "band", "y", "x", (F.col("l2") - F.col("l1")).alias("residual"))
    keys, w = ["pred_date", "band"], fitfc.area_weights(32, 4)
    return _rounded(fitfc.resample(r, "residual", w, w, keys), "pred_date", "band", "y", "x")


def _fitfc_sql(regressed: str) -> str:
    return f"""WITH {regressed}, small AS (SELECT pred_date, band, y // 4 AS sy, x // 4 AS sx, avg(residual) AS r FROM reg GROUP BY 1, 2, 3, 4), cw AS (SELECT * FROM (VALUES {_CUBIC}) t(o, i, w)),
 up AS (SELECT pred_date, band, a.o AS y, b.o AS x, sum(r * a.w * b.w) / sum(a.w * b.w) AS r FROM small JOIN cw a ON sy = a.i JOIN cw b ON sx = b.i GROUP BY 1, 2, 3, 4),
 val AS (SELECT reg.*, frm + up.r AS v FROM reg JOIN up USING (pred_date, band, y, x)),
 piv AS (SELECT pred_date, y, x, {', '.join(f'any_value(h1) FILTER (band = {c}) AS h{c}, any_value(v) FILTER (band = {c}) AS v{c}' for c in range(3))} FROM val GROUP BY 1, 2, 3 HAVING count(*) = 3),
 near AS (SELECT a.pred_date, a.y, a.x, {', '.join(f'b.v{c}' for c in range(3))}, (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) AS d2,
   row_number() OVER (PARTITION BY a.pred_date, a.y, a.x ORDER BY {' + '.join(f'(a.h{c} - b.h{c}) * (a.h{c} - b.h{c})' for c in range(3))}, (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x), b.y - a.y, b.x - a.x) AS rank
   FROM piv a JOIN piv b ON a.pred_date = b.pred_date AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3),
 w AS (SELECT *, 1 / (1 + 2 * sqrt(d2) / 7) AS w FROM near WHERE rank <= 5)
 {' UNION ALL '.join(f'SELECT pred_date, y, x, {c} AS band, round(sum(w * v{c}) / sum(w) + 1e-9, 4) + 0.0 AS value FROM w GROUP BY 1, 2, 3' for c in range(3))}"""


@query("fitfc_predict", _fitfc_sql(_REGRESSED))
def fitfc_predict(spark, d):
    out = fitfc.predict(_aligned(spark, d, False), 3, 32, 32, fitfc.FitFCOptions(window=7, neighbors=5, resolution_factor=4, tile=16), cut=False)
    return out.select("pred_date", "y", "x", F.posexplode("value").alias("band", "value")).filter("value is not null").withColumn("value", F.round(F.col("value") + NUDGE, 4) + 0.0)


def _pair_sql(k: int, date: int) -> str:
    return f"SELECT pred_date, y, x, band, value, {date} AS pair FROM ({_fitfc_sql(_regressed(k, False))})"


@query("fitfc_job_two_pairs", _pair_sql(1, 1) + " UNION ALL " + _pair_sql(3, 7))
def fitfc_job_two_pairs(spark, d):
    """Each date from the pair on either side of it."""
    o = fitfc.FitFCOptions(window=7, neighbors=5, resolution_factor=4, tile=16, dtype="float64")
    out = api.fitfc_job(_images(spark, d), [2, 3, 4, 5, 6], 3, 32, 32, o, 1, 7)
    return out.filter("valid").select(F.col("date").alias("pred_date"), "y", "x", "band", (F.round(F.col("value") + NUDGE, 4) + 0.0).alias("value"), "pair")


def _banded(spark: SparkSession, d: str) -> DataFrame:
    names = ("h1", "h3", "l1", "l3", "l2", "ok")
    return _aligned(spark, d, True).groupBy("pred_date", "y", "x").agg(*[estarfm.by_band(n).alias(n) for n in names])


@query("estarfm_local_weight", f"""WITH {_LOWPX}, p AS (SELECT pred_date, y, x, unnest([l1, l3]) AS lo, unnest([h1, h3]) AS hi FROM al WHERE h1 IS NOT NULL AND h3 IS NOT NULL AND l2 IS NOT NULL)
 SELECT pred_date, y, x, round(CASE WHEN var_pop(lo) < 1e-20 OR var_pop(hi) < 1e-20 THEN 1 ELSE covar_pop(lo, hi) / sqrt(var_pop(lo) * var_pop(hi)) END, 6) + 0.0 AS weight FROM p GROUP BY 1, 2, 3 HAVING count(*) = 6""")
def estarfm_local_weight(spark, d):
    cells = _aligned(spark, d, True).filter("ok").select("pred_date", "y", "x", F.explode(F.array(F.struct(F.col("l1").alias("lo"), F.col("h1").alias("hi")), F.struct(F.col("l3").alias("lo"), F.col("h3").alias("hi")))).alias("e"))
    lo, hi = F.col("e.lo"), F.col("e.hi")
    r = F.covar_pop(lo, hi) / F.sqrt(F.var_pop(lo) * F.var_pop(hi))
    flat = (F.var_pop(lo) < 1e-20) | (F.var_pop(hi) < 1e-20)
    return cells.groupBy("pred_date", "y", "x").agg((F.round(F.when(flat, 1.0).otherwise(r), 6) + 0.0).alias("weight"), F.count("*").alias("n")).filter("n = 6").drop("n")


_ESTARFM_ALL = " AND ".join(f"a.ok{c} AND b.ok{c} AND abs(a.h1_{c} - b.h1_{c}) <= a.tol1_{c} AND abs(a.h3_{c} - b.h3_{c}) <= a.tol3_{c}" for c in range(3))
_ESTARFM_PIVOT = ", ".join(f"max({n}) FILTER (band = {c}) AS {n}_{c}" for n in ("h1", "h3", "l1", "l3", "l2") for c in range(3))
_ESTARFM_OUT = " UNION ALL ".join(
    f"SELECT pred_date, y, x, {c} AS band, CASE WHEN n <= 5 THEN p1_{c} * h1_{c} + p3_{c} * h3_{c} WHEN f_{c} < 0 OR f_{c} > 255 THEN p1_{c} * wh1_{c} / sw + p3_{c} * wh3_{c} / sw ELSE f_{c} END AS v FROM r3" for c in range(3)
)


def _moments(c: int) -> str:
    """Sums over the similar neighbours of one band: both pairs' low values against high ones."""
    parts = {"mx": "b.l1_{c} + b.l3_{c}", "my": "b.h1_{c} + b.h3_{c}", "mxx": "b.l1_{c} * b.l1_{c} + b.l3_{c} * b.l3_{c}", "mxy": "b.l1_{c} * b.h1_{c} + b.l3_{c} * b.h3_{c}", "myy": "b.h1_{c} * b.h1_{c} + b.h3_{c} * b.h3_{c}"}
    return "".join(f", sum(CASE WHEN {_ESTARFM_ALL} THEN {e.format(c=c)} ELSE 0 END) AS {n}_{c}" for n, e in parts.items())


def _critical(m: int) -> float:
    """Where the distribution function of F(1, m) reaches 0.95."""
    low, high = 0.0, 1e6
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if estarfm.f_cdf(np.array([middle]), np.array([float(m)]))[0] >= 0.95 else (middle, high)
    return high


def _trusted(limit: float) -> str:
    """v_c: the slope of a band where it can be trusted and the values deviate enough, 1 elsewhere."""
    table = ", ".join(f"({n}, {_critical(n - 2)!r}::DOUBLE)" for n in range(4, 51, 2))
    first = ", ".join(f"2 * n * mxx_{c} - mx_{c} * mx_{c} AS det_{c}, 2 * n * mxy_{c} - mx_{c} * my_{c} AS top_{c}, 2 * n * myy_{c} - my_{c} * my_{c} AS vy_{c}, sqrt(greatest((mxx_{c} - mx_{c} * mx_{c} / (2 * n)) / (2 * n - 1), 0)) AS dev_{c}" for c in range(3))
    slope = []
    for c in range(3):
        r2 = f"(top_{c} * top_{c} / (det_{c} * vy_{c}))"
        f = f"CASE WHEN det_{c} * vy_{c} <> 0 AND {r2} > 0 AND {r2} < 1 THEN (2 * n - 2) / (1 / {r2} - 1) END"
        b = f"top_{c} / det_{c}"
        slope.append(f"CASE WHEN dev_{c} <= {limit!r} OR abs(det_{c}) < 1e-14 OR {b} < 0 OR {b} > 5 THEN 1 WHEN {f} < crit THEN 1 ELSE {b} END AS v_{c}")
    return f"ft AS (SELECT * FROM (VALUES {table}) t(fn, crit)), r2b AS (SELECT r2.*, crit, {first} FROM r2 LEFT JOIN ft ON fn = 2 * n), r2c AS (SELECT *, {', '.join(slope)} FROM r2b),"


def _estarfm_sql(classes: int = 4, limit: float = 1e9, also=lambda c: "true") -> str:
    return f"""WITH {_LOWPX}, w0 AS (SELECT pred_date, y, x, {_ESTARFM_PIVOT} FROM al GROUP BY 1, 2, 3),
 w1 AS (SELECT *, {', '.join(f'h1_{c} IS NOT NULL AND h3_{c} IS NOT NULL AND l1_{c} IS NOT NULL AND l3_{c} IS NOT NULL AND l2_{c} IS NOT NULL AND {also(c)} AS ok{c}' for c in range(3))} FROM w0),
 w2 AS (SELECT *, {', '.join(f'stddev_pop(h1_{c}) FILTER (ok{c}) OVER (PARTITION BY pred_date) * 2 / {classes} AS tol1_{c}, stddev_pop(h3_{c}) FILTER (ok{c}) OVER (PARTITION BY pred_date) * 2 / {classes} AS tol3_{c}' for c in range(3))},
   list_transform([{', '.join(f'CASE WHEN ok{c} THEN {n}_{c} ELSE 0 END' for n in ('l1', 'l3') for c in range(3))}], lambda v: CAST(v AS DOUBLE)) AS lo, list_transform([{', '.join(f'CASE WHEN ok{c} THEN {n}_{c} ELSE 0 END' for n in ('h1', 'h3') for c in range(3))}], lambda v: CAST(v AS DOUBLE)) AS hi FROM w1),
 w3 AS (SELECT *, CASE WHEN list_var_pop(lo) < 1e-20 OR list_var_pop(hi) < 1e-20 THEN 1 ELSE (list_dot_product(lo, hi) / 6 - list_avg(lo) * list_avg(hi)) / sqrt(list_var_pop(lo) * list_var_pop(hi)) END AS lw FROM w2),
 j AS (SELECT a.pred_date, a.y, a.x, {', '.join(f'any_value(a.h1_{c}) AS h1_{c}, any_value(a.h3_{c}) AS h3_{c}, abs(sum(CASE WHEN b.ok{c} THEN b.l1_{c} - b.l2_{c} ELSE 0 END)) AS d1_{c}, abs(sum(CASE WHEN b.ok{c} THEN b.l3_{c} - b.l2_{c} ELSE 0 END)) AS d3_{c}, sum(CASE WHEN {_ESTARFM_ALL} THEN w * (b.l2_{c} - b.l1_{c}) ELSE 0 END) AS e1_{c}, sum(CASE WHEN {_ESTARFM_ALL} THEN w * (b.l2_{c} - b.l3_{c}) ELSE 0 END) AS e3_{c}, sum(CASE WHEN {_ESTARFM_ALL} THEN w * b.h1_{c} ELSE 0 END) AS wh1_{c}, sum(CASE WHEN {_ESTARFM_ALL} THEN w * b.h3_{c} ELSE 0 END) AS wh3_{c}' + _moments(c) for c in range(3))},
   sum(CASE WHEN {_ESTARFM_ALL} THEN w ELSE 0 END) AS sw, count(*) FILTER ({_ESTARFM_ALL}) AS n
   FROM w3 a, w3 b, LATERAL (SELECT 1 / ((1 - b.lw) * (1 + 2 * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / 5) + 1e-7) AS w) u
   WHERE a.pred_date = b.pred_date AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND a.ok0 AND a.ok1 AND a.ok2 GROUP BY 1, 2, 3),
 r2 AS (SELECT *, {', '.join(f'(1 / (d1_{c} + 1e-10)) / (1 / (d1_{c} + 1e-10) + 1 / (d3_{c} + 1e-10)) AS p1_{c}, (1 / (d3_{c} + 1e-10)) / (1 / (d1_{c} + 1e-10) + 1 / (d3_{c} + 1e-10)) AS p3_{c}' for c in range(3))} FROM j),
 {_trusted(limit)}
 r3 AS (SELECT *, {', '.join(f'p1_{c} * (h1_{c} + v_{c} * e1_{c} / sw) + p3_{c} * (h3_{c} + v_{c} * e3_{c} / sw) AS f_{c}' for c in range(3))} FROM r2c)
 SELECT pred_date, y, x, CAST(band AS INT) AS band, round(v + 1e-9, 3) + 0.0 AS value FROM ({_ESTARFM_OUT})"""


@query("estarfm_predict", _estarfm_sql())
def estarfm_predict(spark, d):
    # an uncertainty this large keeps every conversion factor at 1, which SQL can express
    o = estarfm.EstarfmOptions(window=5, classes=4, uncertainty=1e6, tile=16)
    out = estarfm.predict(_banded(spark, d), 3, o, cut=False)
    return out.select("pred_date", "y", "x", F.posexplode("value").alias("band", "value")).filter("value is not null").withColumn("value", F.round(F.col("value") + NUDGE, 3) + 0.0)


_FACTOR = 0.002 * 255 * 2**0.5


@query("estarfm_regress", _estarfm_sql(2, _FACTOR))
def estarfm_regress(spark, d):
    """Conversion factors from regression, tested by F."""
    out = estarfm.predict(_banded(spark, d), 3, estarfm.EstarfmOptions(window=5, classes=2, tile=16), cut=False)
    return out.select("pred_date", "y", "x", F.posexplode("value").alias("band", "value")).filter("value is not null").withColumn("value", F.round(F.col("value") + NUDGE, 3) + 0.0)


@query("estarfm_job_nodata", _estarfm_sql(2, _FACTOR, lambda c: " AND ".join([*(f"{h}_{c} <> 100" for h in ("h1", "h3")), *(f"{v}_{c} NOT BETWEEN 120 AND 125" for v in ("l1", "l3", "l2"))])))
def estarfm_job_nodata(spark, d):
    """A job whose images have missing values and forbidden ranges."""
    job = api.JobMasks(nodata={"high": 100.0}, low_ranges=[("invalid", IntervalSet.parse("[120,125]"))])
    out = api.estarfm_job(_images(spark, d), [2, 3, 4, 5, 6], 3, estarfm.EstarfmOptions(window=5, classes=2, tile=16, dtype="float64"), 1, 7, job_masks=job)
    return out.filter("valid").select(F.col("date").alias("pred_date"), "y", "x", "band", (F.round(F.col("value") + NUDGE, 3) + 0.0).alias("value"))


# --- colours and indices -------------------------------------------------------------------------
def _color(name: str, columns: dict[str, str], fn):
    @query(name, f"WITH {RGB} SELECT x, y, d, {_round_sql(columns)} FROM rgb")
    def run(spark, d):
        r, g, b = (F.col(c) / 255.0 for c in BANDS)
        got = fn(r, g, b)
        got = got if isinstance(got, tuple) else (got,)
        return _rounded(fine_raster(spark, d).select("x", "y", "d", *[c.alias(n) for c, n in zip(got, columns, strict=True)]), "x", "y", "d")


_Y = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
_X3 = [f"(r * {a}::DOUBLE + g * {b}::DOUBLE + b * {c}::DOUBLE)" for a, b, c in color.XYZ]
_color("gray", {"v": _Y}, color.gray)
_color("ycbcr", {"v": _Y, "cb": f"(b - {_Y}) * 0.564::DOUBLE + 0.5", "cr": f"(r - {_Y}) * 0.713::DOUBLE + 0.5"}, color.ycbcr)
_color("xyz", dict(zip(("cx", "cy", "cz"), _X3, strict=True)), color.xyz)
_fl = lambda t: f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} * 7.787::DOUBLE + {16 / 116!r}::DOUBLE END)"
_LL = f"(CASE WHEN {_X3[1]} > 0.008856 THEN cbrt({_X3[1]}) * 116 - 16 ELSE {_X3[1]} * 903.3::DOUBLE END)"
_XN, _ZN = f"({_X3[0]} / {color.WHITE[0]}::DOUBLE)", f"({_X3[2]} / {color.WHITE[2]}::DOUBLE)"
_color("lab", {"l": _LL, "a": f"({_fl(_XN)} - {_fl(_X3[1])}) * 500", "bb": f"({_fl(_X3[1])} - {_fl(_ZN)}) * 200"}, color.lab)
_DUV = f"({_X3[0]} + {_X3[1]} * 15 + {_X3[2]} * 3)"
_color("luv", {"l": _LL, "u": f"{_LL} * 13 * (CASE WHEN {_DUV} = 0 THEN 0 ELSE {_X3[0]} * 4 / {_DUV} END - 0.19793943::DOUBLE)", "v": f"{_LL} * 13 * (CASE WHEN {_DUV} = 0 THEN 0 ELSE {_X3[1]} * 9 / {_DUV} END - 0.46831096::DOUBLE)"}, color.luv)
_TOP, _SPAN = "greatest(r, g, b)", "(greatest(r, g, b) - least(r, g, b))"
_HUE0 = f"(CASE WHEN {_SPAN} = 0 THEN 0 WHEN {_TOP} = r THEN (g - b) * 60 / {_SPAN} WHEN {_TOP} = g THEN (b - r) * 60 / {_SPAN} + 120 ELSE (r - g) * 60 / {_SPAN} + 240 END)"
_HUE = f"(CASE WHEN {_HUE0} < 0 THEN {_HUE0} + 360 ELSE {_HUE0} END)"
_color("hsv", {"h": _HUE, "s": f"CASE WHEN {_TOP} = 0 THEN 0 ELSE {_SPAN} / {_TOP} END", "v": _TOP}, color.hsv)
_LIGHT = "((greatest(r, g, b) + least(r, g, b)) / 2)"
_color("hls", {"h": _HUE, "l": _LIGHT, "s": f"CASE WHEN {_SPAN} = 0 THEN 0 WHEN {_LIGHT} < 0.5 THEN {_SPAN} / ({_TOP} + least(r, g, b)) ELSE {_SPAN} / (2.0::DOUBLE - {_TOP} - least(r, g, b)) END"}, color.hls)
_NDI = lambda p, n: f"(CASE WHEN {p} + {n} = 0 THEN 0 ELSE ({p} - {n}) / ({p} + {n}) END)"
_color("ndvi", {"v": _NDI("g", "r")}, lambda r, g, b: color.difference_index(g, r))
_color("build_up", {"v": f"({_NDI('b', 'g')} - {_NDI('g', 'r')}) / 2"}, color.build_up)
_color("rgb_round_trips", {n: c for n, c in zip(("r1", "g1", "b1", "r2", "g2", "b2"), "rgbrgb", strict=True)}, lambda r, g, b: (*color.hsv_to_rgb(*color.hsv(r, g, b)), *color.hls_to_rgb(*color.hls(r, g, b))))


def _cap(sensor: str, m: tuple):
    names = ("brightness", "greenness", "wetness")
    sums = {n: " + ".join(f"e{i} * {c}::DOUBLE" for i, c in enumerate(row)) for n, row in zip(names, m, strict=True)}

    @query(f"tasseled_{sensor}", f"WITH {EMB} SELECT x, y, {_round_sql(sums)} FROM emb")
    def run(spark, d):
        cap = color.tasselled_cap([F.col(f"e{i}") for i in range(len(m[0]))], sensor)
        return _rounded(_embedding_cells(spark, d).select("x", "y", *[c.alias(n) for c, n in zip(cap, names, strict=True)]), "x", "y")


_cap("landsat", color.LANDSAT_CAP)
_cap("modis", color.MODIS_CAP)


@query("palette_expand", "SELECT p_partkey, CAST(CASE WHEN p_size < 40 THEN p_size * 3 ELSE 0 END AS INT) AS r, CAST(CASE WHEN p_size < 40 THEN 255 - p_size ELSE 0 END AS INT) AS g, CAST(CASE WHEN p_size < 40 THEN p_size % 7 ELSE 0 END AS INT) AS b FROM part")
def palette_expand(spark, d):
    from tessera.sources.palette import expand

    palette = spark.createDataFrame([(i, i * 3, 255 - i, i % 7) for i in range(40)], "index int, r int, g int, b int")
    return expand(spark.read.parquet(f"{d}/part.parquet"), "p_size", palette).select("p_partkey", "r", "g", "b")


@query("affine_img_to_proj", f"WITH {FINE} SELECT x, y, d, x * 30.0::DOUBLE + y * 0.5::DOUBLE + 500000 AS px, x * 0.25::DOUBLE + y * -30.0::DOUBLE + 4000000 AS py FROM fine")
def affine_img_to_proj(spark, d):
    px, py = GeoTransform(500000.0, 30.0, 0.5, 4000000.0, 0.25, -30.0).image_to_projection(F.col("x"), F.col("y"))
    return fine_raster(spark, d).select("x", "y", "d", px.alias("px"), py.alias("py"))


# --- disturbance ---------------------------------------------------------------------------------
def _di_sql() -> str:
    cap = [" + ".join(f"e{i} * {c}::DOUBLE" for i, c in enumerate(row)) for row in color.LANDSAT_CAP]
    z = lambda n: f"({n} - avg({n}) OVER w) / CASE WHEN stddev_pop({n}) OVER w = 0 THEN 1 ELSE stddev_pop({n}) OVER w END"
    return f"""{EMB}, cap AS (SELECT x, y, label, {cap[0]} AS b, {cap[1]} AS g, {cap[2]} AS w0 FROM emb), zz AS (SELECT x, y, {z('b')} AS brightness, {z('g')} AS greenness, {z('w0')} AS wetness FROM cap WINDOW w AS (PARTITION BY label)),
    di AS (SELECT *, brightness - greenness - wetness AS di FROM zz)"""


def _di(spark: SparkSession, d: str) -> DataFrame:
    return staarch.indices(_embedding_cells(spark, d), [f"e{i}" for i in range(6)], "landsat", ["label"])


@query("disturbance_index", f"WITH {_di_sql()} SELECT x, y, {_round_sql({'di': 'di', 'brightness': 'brightness'})} FROM di")
def disturbance_index(spark, d):
    return _rounded(_di(spark, d).select("x", "y", "di", "brightness"), "x", "y")


@query("neighbor_exceed", f"WITH {_di_sql()} SELECT a.x, a.y, a.di >= 0.5 AND coalesce(bool_or(b.di >= 0.5), false) AS exceeds FROM di a LEFT JOIN di b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.x, a.y, a.di")
def neighbor_exceed(spark, d):
    return staarch.with_neighbour(_di(spark, d).withColumn("one", F.lit(1)), F.col("di") >= 0.5, ["one"]).select("x", "y", "exceeds")


@query("change_mask", f"WITH {DENSE}, h AS (SELECT y, x, d, coalesce(b0 >= 120, false) AS hit FROM dense) SELECT b.y, b.x, b.hit AND NOT a.hit AS changed FROM h a JOIN h b ON a.y = b.y AND a.x = b.x WHERE a.d = 1 AND b.d = 7")
def change_mask(spark, d):
    hit = lambda day: dense_raster(spark, d).filter(F.col("d") == day).select("y", "x", F.coalesce(F.col("b0") >= 120, F.lit(False)).alias("disturbed"))
    return staarch.change_mask(hit(1), hit(7))


_SERIES = f"{DENSE}, s AS (SELECT y, x, d AS date, CAST(b0 AS DOUBLE) AS di, ok AND b0 IS NOT NULL AS valid FROM dense)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return dense_raster(spark, d).select("y", "x", F.col("d").alias("date"), F.col("b0").cast("double").alias("di"), (F.col("ok") & F.col("b0").isNotNull()).alias("valid"))


def _average(direction: str, frame: str):
    @query(f"di_moving_avg_{direction}", f"WITH {_SERIES} SELECT y, x, date, round(coalesce(avg(CASE WHEN valid THEN di END) OVER w, di), 6) + 0.0 AS di, bool_or(valid) OVER w AS valid FROM s WINDOW w AS (PARTITION BY y, x ORDER BY date ROWS BETWEEN {frame})")
    def run(spark, d):
        return staarch.moving_average(_series(spark, d), 3, direction).withColumn("di", F.round("di", 6) + 0.0)


_average("forward", "CURRENT ROW AND 2 FOLLOWING")
_average("backward", "2 PRECEDING AND CURRENT ROW")
_average("center", "1 PRECEDING AND 1 FOLLOWING")
_LIMIT = "SELECT y, x, min(di) FILTER (valid) + (max(di) FILTER (valid) - min(di) FILTER (valid)) * 0.5 AS lim FROM s GROUP BY 1, 2"


@query("di_threshold", f"WITH {_SERIES} SELECT y, x, round(lim, 6) + 0.0 AS lim FROM ({_LIMIT})")
def di_threshold(spark, d):
    return staarch.threshold(_series(spark, d), 0.5).select("y", "x", (F.round("limit", 6) + 0.0).alias("lim"))


@query("date_of_disturbance", f"WITH {_SERIES} SELECT y, x, CAST(coalesce(min(CASE WHEN valid AND (x + y) % 2 = 0 AND di >= lim THEN date END), 2147483647) AS INT) AS dod FROM s JOIN ({_LIMIT}) USING (y, x) GROUP BY 1, 2")
def date_of_disturbance(spark, d):
    s = _series(spark, d)
    return staarch.date_of_disturbance(s, s.select("y", "x").distinct().withColumn("changed", (F.col("x") + F.col("y")) % 2 == 0), 0.5)


@query("staarch_predict", f"WITH {_SERIES}, m AS (SELECT y, x, date, di, CASE WHEN x < 8 THEN 2147483647 ELSE x % 7 END AS dod FROM s) SELECT date AS pred_date, y, x, 0 AS band, CASE WHEN dod = 2147483647 THEN di WHEN dod > date THEN di + 1 ELSE di + 2 END AS value FROM m")
def staarch_predict(spark, d):
    p = _series(spark, d).select(F.col("date").alias("pred_date"), "y", "x", F.lit(0).alias("band"), F.col("di").alias("value"))
    dod = p.select("y", "x").distinct().withColumn("dod", F.when(F.col("x") < 8, staarch.NEVER).otherwise(F.col("x") % 7).cast("int"))
    return staarch.merge_predictions(p, p.withColumn("value", F.col("value") + 1), p.withColumn("value", F.col("value") + 2), dod)


@query("kmeans_classes", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM embeddings")
def kmeans_classes(spark, d):
    """Labels are any; what SQL can say is that every cell is nearest the mean of its own class."""
    bands = [f"e{i}" for i in range(6)]
    found = staarch.land_classes(_embedding_cells(spark, d), bands, 10, iterations=1000, tolerance=0.0)
    means = found.groupBy("land_class").agg(*[F.avg(b).alias(f"m_{b}") for b in bands])
    apart = sum(((F.col(b) - F.col(f"m_{b}")) * (F.col(b) - F.col(f"m_{b}")) for b in bands), F.lit(0.0))
    ranked = found.withColumnRenamed("land_class", "own").crossJoin(F.broadcast(means)).withColumn("apart", apart)  # ten classes
    near = ranked.groupBy("x", "y").agg(F.min("apart").alias("least"), F.max(F.when(F.col("own") == F.col("land_class"), F.col("apart"))).alias("mine"))
    return near.agg(F.count("*").alias("n"), F.count_if(F.col("mine") > F.col("least") + 1e-9).alias("misplaced"))


def _staarch_sql() -> str:
    """From images to dates of disturbance: whole images as one class."""
    high = ["b0", "b1", "b2", "b1", "b2", "b0"]
    low = ["b0", "b1", "b2", "b0", "b1", "b2", "b0"]
    cap = lambda m, bands: [" + ".join(f"{b} * {c}::DOUBLE" for b, c in zip(bands, row, strict=True)) for row in m]
    hb, hg, hw = cap(color.LANDSAT_CAP, high)
    lb, lg, lw = cap(color.MODIS_CAP, low)
    z = lambda n, by: f"(CASE WHEN good THEN {n} END - avg(CASE WHEN good THEN {n} END) OVER {by}) / CASE WHEN stddev_pop(CASE WHEN good THEN {n} END) OVER {by} = 0 THEN 1 ELSE stddev_pop(CASE WHEN good THEN {n} END) OVER {by} END"
    return f"""WITH {LOW}, h0 AS (SELECT d, y, x, b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AS one, {hb} AS b, {hg} AS g, {hw} AS w, CASE WHEN b1 + b2 = 0 THEN 0 ELSE (b1 - b2) / (b1 + b2) END AS nd FROM dense WHERE d IN (1, 7)),
    h1 AS (SELECT *, bool_and(one) OVER (PARTITION BY y, x) AS good FROM h0), h2 AS (SELECT d, y, x, {z('b', 'v')} AS b, {z('g', 'v')} AS g, {z('w', 'v')} AS w, {z('nd', 'v')} AS nd FROM h1 WINDOW v AS (PARTITION BY d)),
    h3 AS (SELECT *, coalesce(b - g - w >= 0.5, false) AS hit FROM h2), h4 AS (SELECT p.d, p.y, p.x, p.hit AND bool_or(q.hit) AND any_value(p.b) >= -3 AND any_value(p.w) <= 1 AS bad FROM h3 p JOIN h3 q ON p.d = q.d AND abs(p.x - q.x) + abs(p.y - q.y) = 1 GROUP BY p.d, p.y, p.x, p.hit),
    ch AS (SELECT r.y, r.x, coalesce(r.bad, false) AND NOT coalesce(l.bad, false) AS changed FROM h4 r JOIN h4 l ON l.d = 1 AND l.y = r.y AND l.x = r.x WHERE r.d = 7),
    l0 AS (SELECT d, y, x, true AS good, {lb} AS b, {lg} AS g, {lw} AS w FROM low), l1 AS (SELECT d, y, x, {z('b', 'v')} - ({z('g', 'v')}) - ({z('w', 'v')}) AS di FROM l0 WINDOW v AS (PARTITION BY d)),
    l2 AS (SELECT d, y, x, avg(di) OVER (PARTITION BY y, x ORDER BY d ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS di FROM l1),
    lim AS (SELECT y, x, round(min(di) + (max(di) - min(di)) * 0.5, 9) AS lim FROM l2 GROUP BY 1, 2), dod AS (SELECT y, x, CAST(coalesce(min(CASE WHEN changed AND round(di, 9) >= lim THEN d END), 2147483647) AS INT) AS dod FROM l2 JOIN lim USING (y, x) JOIN ch USING (y, x) GROUP BY 1, 2)"""


def _staarch_images(spark: SparkSession, d: str) -> DataFrame:
    """High images of six bands at both ends and low ones of seven at all dates."""
    wide = lambda df, bands: df.select(*[c for c in ("d", "y", "x", "ok")], *[F.col(b).alias(f"s{i}") for i, b in enumerate(bands)])
    high = wide(dense_raster(spark, d).filter("d in (1, 7)"), ["b0", "b1", "b2", "b1", "b2", "b0"])
    low = wide(low_raster(dense_raster(spark, d)), ["b0", "b1", "b2", "b0", "b1", "b2", "b0"])
    p = long_form(high, "high", [f"s{i}" for i in range(6)]).unionByName(long_form(low, "low", [f"s{i}" for i in range(7)]))
    return p.withColumn("valid", F.col("value").isNotNull())


_STAARCH = staarch.StaarchOptions(clusters=1, ratio=0.5, index=IntervalSet.parse("[0.5,inf)"), wetness=IntervalSet.parse("(-inf,1]"), ndvi=IntervalSet.everything())


@query("staarch_dates", _staarch_sql() + " SELECT * FROM dod")
def staarch_dates(spark, d):
    p = _staarch_images(spark, d)
    changed = staarch.disturbance(p, 1, 7, _STAARCH)
    return staarch.date_of_disturbance(staarch.low_series(p, list(range(1, 8)), _STAARCH), changed, _STAARCH.ratio)


@query("staarch_change_mask", _staarch_sql() + " SELECT y, x, changed FROM ch")
def staarch_change_mask(spark, d):
    return staarch.disturbance(_staarch_images(spark, d), 1, 7, _STAARCH)
