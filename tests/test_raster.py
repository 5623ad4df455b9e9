"""Grammar, masks, sources, fusion and gap filling on small hand-made rasters."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import api
from tessera.errors import FileFormatError, ImageTypeError, InvalidArgument, NotFound, SizeError
from tessera.functions import arith, color
from tessera.functions.geo import GeoTransform, Rectangle
from tessera.functions.intervals import Interval, IntervalSet, ordered_set
from tessera.model import truncate
from tessera.operators import aggregates, estarfm, fitfc, interpolation, starfm
from tessera.plans import planner
from tessera.sources import raster, tiff
from tessera.streaming.gapfill import settle_series


# --- intervals -----------------------------------------------------------------------------------
def member(s, v):
    return any((i.low < v or (i.low == v and i.low_closed)) and (v < i.high or (v == i.high and i.high_closed)) for i in s.parts)


INTERVALS = st.builds(lambda a, w, lc, hc: Interval(a, a + w, lc, hc), st.integers(-3, 3), st.integers(0, 3), st.booleans(), st.booleans())


@given(st.lists(INTERVALS, max_size=4), st.lists(INTERVALS, max_size=4))
def test_set_algebra(a, b):
    x, y = IntervalSet(tuple(a)).normal(), IntervalSet(tuple(b)).normal()
    for v in np.arange(-4, 8, 0.5):
        assert member(x | y, v) == (member(x, v) or member(y, v))
        assert member(x - y, v) == (member(x, v) and not member(y, v))
        assert member(x & y, v) == (member(x, v) and member(y, v))


def test_grammar():
    assert Interval.parse("[1,3)") == Interval(1, 3, True, False)
    assert Interval.parse("4") == Interval(4, 4) and Interval.parse("1,2") == Interval(1, 2, False, False)
    assert Interval.parse("[-inf,2]") == Interval(-math.inf, 2, False, True)
    assert ordered_set([("invalid", IntervalSet.parse("[0,1]"))]) == IntervalSet.everything() - IntervalSet.parse("[0,1]")
    assert ordered_set([("valid", IntervalSet.parse("[0,9]")), ("invalid", IntervalSet.parse("[3,4]"))]).discrete().parts == (Interval(0, 2), Interval(5, 9))
    for bad in ("x", "[3,1]", ""):
        with pytest.raises(InvalidArgument):
            IntervalSet.parse(bad)


def test_predicates_and_rounding(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,), (2.5,), (-1.5,)], "v double")
    v = F.col("v")
    got = [tuple(r) for r in df.select(IntervalSet.parse("[2,inf)").contains(v), arith.convert(v, "uint8"), truncate(v, "int8")).collect()]
    assert [g[0] for g in got] == [False, False, True, True, False]
    assert got[3][1:] == (2.0, 2.0) and got[4][1:] == (0.0, -1.0)
    with pytest.raises(InvalidArgument):
        arith.divide(v, 0, "uint8")
    with pytest.raises(ImageTypeError):
        arith.convert(v, "uint7")


def test_colour_round_trips(spark):
    df = spark.createDataFrame([(r / 4, g / 4, b / 4) for r in range(5) for g in range(5) for b in range(5)], "r double, g double, b double")
    rgb = [F.col(c) for c in "rgb"]
    for there, back in ((color.hsv, color.hsv_to_rgb), (color.hls, color.hls_to_rgb), (color.lab, color.lab_to_rgb), (color.luv, color.luv_to_rgb), (color.ycbcr, color.ycbcr_to_rgb), (color.xyz, color.xyz_to_rgb)):
        mid = df.select(*rgb, *[c.alias(f"m{i}") for i, c in enumerate(there(*rgb))])
        out = mid.select(*rgb, *[c.alias(f"o{i}") for i, c in enumerate(back(*[F.col(f"m{i}") for i in range(3)]))]).toPandas()
        skip = (out[["r", "g", "b"]].sum(axis=1) == 0) if there is color.luv else np.zeros(len(out), bool)
        assert np.abs(out.loc[~skip, ["r", "g", "b"]].to_numpy() - out.loc[~skip, ["o0", "o1", "o2"]].to_numpy()).max() < 5e-3


def test_geotransform():
    t = GeoTransform(100, 30, 0.5, 200, 0.25, -30).rotate_image(20).translate_image(3, 4).scale_image(2, 3).shear_x_image(0.1)
    x, y = t.projection_to_image(*t.image_to_projection(7.0, 9.0))
    assert (x, y) == pytest.approx((7, 9))
    assert Rectangle(0, 0, 4, 4) & Rectangle(2, 3, 9, 9) == Rectangle(2, 3, 2, 1)
    assert GeoTransform().flip_image(True, False, 10, 5).image_to_projection(0, 0) == (10, 0)


# --- sources -------------------------------------------------------------------------------------
def pixels_of(spark, images):
    """images: (tag, date) -> (bands, height, width), NaN for missing."""
    rows = []
    for (tag, date), a in images.items():
        for (b, y, x), v in np.ndenumerate(np.asarray(a, float)):
            rows.append((tag, date, y, x, b, None if np.isnan(v) else float(v), not np.isnan(v)))
    return spark.createDataFrame(rows, "tag string, date int, y int, x int, band int, value double, valid boolean")


def grid(df, height, width, bands):
    out = np.full((bands, height, width), np.nan)
    for r in df.collect():
        if r["value"] is not None:
            out[r["band"], r["y"], r["x"]] = r["value"]
    return out


@pytest.mark.parametrize("dtype", ["uint8", "int8", "uint16", "int16", "int32", "float32", "float64"])
def test_tiff_round_trip(dtype):
    a = np.random.default_rng(0).integers(0, 100, (3, 5, 7)).astype(dtype)
    info = raster.GeoInfo(7, 5, 3, dtype, (9.0,) * 3, GeoTransform(10, 2, 0, 20, 0, -2))
    back, told = tiff.decode(tiff.encode(a, info))
    assert (back == a).all() and told.base_type == dtype and told.nodata == (9.0,) * 3 and told.geotransform == info.geotransform
    with pytest.raises(FileFormatError):
        tiff.decode(b"none")


def test_files(spark, tmp_path):
    a = np.arange(2 * 4 * 6).reshape(2, 4, 6).astype("int16")
    names = []
    for date in (1, 2):
        path = str(tmp_path / f"im{date}.tif")
        (tmp_path / f"im{date}.tif").write_bytes(tiff.encode(a + date, raster.GeoInfo(6, 4, 2, "int16", (5.0, 5.0))))
        names.append(("high", date, path))
    got = raster.read_tiff(spark, names, bands=[1], crop=Rectangle(2, 1, 3, 2), flip_x=True)
    assert (grid(got.filter("date = 2"), 2, 3, 2)[1] == (a + 2)[1, 1:3, 2:5][:, ::-1]).all()
    whole = raster.read_tiff(spark, names)
    assert whole.filter("not valid").select("value").distinct().collect() == [(5.0,)]
    table = raster.catalog(spark, names)
    raster.check_alike(table)
    assert sorted((r["date"], r["width"], r["base_type"]) for r in table.collect()) == [(1, 6, "int16"), (2, 6, "int16")]
    raster.write_pixels(whole, str(tmp_path / "store"))
    again = raster.read_pixels(spark, str(tmp_path / "store"))
    assert again.count() == whole.count()
    blob = raster.to_tiffs(again.filter("date = 1"), raster.GeoInfo(6, 4, 2, "int16", (5.0, 5.0))).first()["content"]
    assert (tiff.decode(blob)[0] == a + 1).all()
    with pytest.raises(SizeError):
        raster.GeoInfo(6, 4, 2, "int16").cropped(Rectangle(4, 0, 5, 1))
    with pytest.raises(InvalidArgument):
        raster.GeoInfo(6, 4, 2, "int16").with_bands([2])
    assert raster.format_of("x.TIF") == "GTiff" and raster.output_name("p_", 5, 1, 9) == "p_5_from_1_and_9.tif" and raster.output_name("", 1, 1) == "predicted_predicted.tif"


def test_collection(spark):
    c = raster.Collection(pixels_of(spark, {("a", 1): np.ones((1, 2, 2)), ("b", 2): np.ones((1, 2, 2))}))
    assert c.tags() == ["a", "b"] and c.dates("b") == [2] and c.count() == 2 and not c.has("a", 2)
    changed = c.put(pixels_of(spark, {("a", 1): np.full((1, 2, 2), 7)}))
    assert changed.get("a", 1).first()["value"] == 7 and changed.count() == 2 and changed.remove("b").keys() == [("a", 1)]
    with pytest.raises(NotFound):
        c.get("a", 9)


def test_statistics(spark):
    p = pixels_of(spark, {("a", 1): [[[3, 1], [3, np.nan]]]})
    row = aggregates.min_max_places(p).first()
    assert (row["low"], row["at_low"]["x"], row["high"], tuple(row["at_high"])) == (1, 1, 3, (0, 0))
    assert aggregates.mean_std(p, sample=True).first()["mean"] == pytest.approx(7 / 3)
    assert aggregates.unused_value(p, "uint8") == 255 and aggregates.unused_value(p, "int16") == -9999
    full = pixels_of(spark, {("a", 1): np.arange(256).reshape(1, 16, 16)})
    assert aggregates.unused_value(full, "uint8") is None


# --- fusion --------------------------------------------------------------------------------------
def series(rng, side=12, bands=2):
    base = rng.integers(20, 200, (bands, side, side)).astype(float)
    low = np.repeat(np.repeat(base[:, ::4, ::4], 4, 1), 4, 2)
    return {("high", 1): base, ("low", 1): low, ("low", 3): np.clip(low + rng.integers(-9, 9, low.shape), 0, 255), ("high", 5): np.clip(base + 8, 0, 255), ("low", 5): np.clip(low + 8, 0, 255)}


def loop_starfm(im, o, double):
    """One pixel at a time, from the published formulas."""
    ks = (1, 5) if double else (1,)
    now = im["low", 3]
    bands, h, w = now.shape
    out = np.zeros_like(now)
    sat = lambda v: min(max(float(np.rint(v)), 0.0), 255.0)
    s_t, s_s = o.sigma("temporal"), o.sigma("spectral")
    s_dt, s_ds = s_t * 2**0.5, (s_t**2 + s_s**2) ** 0.5
    s_c = (s_dt**2 + s_ds**2) ** 0.5
    r = o.window // 2
    for b in range(bands):
        tol = {k: im["high", k][b].std() * 2 / o.classes for k in ks}
        for y in range(h):
            for x in range(w):
                t_c = min(sat(abs(im["low", k][b, y, x] - now[b, y, x]) + s_dt) for k in ks)
                d_c = min(sat(abs(im["low", k][b, y, x] - im["high", k][b, y, x]) + s_ds) for k in ks)
                ws = wv = 0.0
                for j in range(max(0, y - r), min(h, y + r + 1)):
                    for i in range(max(0, x - r), min(w, x + r + 1)):
                        for k in ks:
                            hk, lk, n = im["high", k][b, j, i], im["low", k][b, j, i], now[b, j, i]
                            s, t = abs(lk - hk), abs(lk - n)
                            if not abs(im["high", k][b, y, x] - hk) < tol[k]:
                                continue
                            if not ((t < t_c and s < d_c) if o.strict else (t < t_c or s < d_c)):
                                continue
                            d = 1 + 2 * math.hypot(j - y, i - x) / o.window
                            tt = t if double else 0
                            wt = 1 / (d * (1 + tt) * (1 + s)) if (1 + tt) * (1 + s) >= s_c else 1.0
                            ws, wv = ws + wt, wv + wt * sat(hk + n - lk)
                mean = np.mean([sat(im["high", k][b, y, x] + now[b, y, x] - im["low", k][b, y, x]) for k in ks])
                out[b, y, x] = wv / ws if ws else mean
    return out


@pytest.mark.parametrize("double", [False, True])
def test_starfm_against_loops(spark, double):
    im = series(np.random.default_rng(1))
    o = starfm.StarfmOptions(window=5, classes=6, tile=5)
    jobs = spark.createDataFrame([(3, 1, 5 if double else None)], "date int, date1 int, date3 int")
    aligned = api.align_jobs(pixels_of(spark, im), jobs, double)
    got = grid(starfm.predict(aligned, o, double, cut=False), 12, 12, 2)
    assert np.abs(got - loop_starfm(im, o, double)).max() < 1e-9
    area = Rectangle(3, 2, 6, 5)
    part = starfm.predict(aligned, starfm.StarfmOptions(window=5, classes=6, tile=64, area=area), double, cut=False)
    assert part.count() == 60 and np.nanmax(np.abs(grid(part, 12, 12, 2) - got)) < 1e-9


def test_no_change_predicts_the_high_image(spark):
    im = series(np.random.default_rng(2))
    im["low", 3] = im["low", 5] = im["low", 1]
    im["high", 5] = im["high", 1]
    p = pixels_of(spark, im)
    own = starfm.StarfmOptions(window=3, classes=1e9, tile=8)
    # a mean of equal values may fall short of them by a rounding error, which is then cut off
    assert np.abs(grid(api.starfm_job(p, [3], own), 12, 12, 2) - im["high", 1]).max() <= 1
    assert (grid(api.fitfc_job(p, [3], 2, 12, 12, fitfc.FitFCOptions(window=5, neighbors=1, resolution_factor=1, tile=8)), 12, 12, 2) == im["high", 1]).all()
    got = grid(api.estarfm_job(p, [3], 2, estarfm.EstarfmOptions(window=3, classes=1e9, tile=8)), 12, 12, 2)
    assert np.abs(got - im["high", 1]).max() <= 1  # results are cut off, not rounded


def test_masked_cells_stay_empty(spark):
    im = series(np.random.default_rng(3))
    im["high", 1][0, 4, 4] = np.nan
    got = grid(api.starfm_job(pixels_of(spark, im), [3], starfm.StarfmOptions(window=3, tile=8), double=False), 12, 12, 2)
    assert np.isnan(got[0, 4, 4]) and not np.isnan(got[1, 4, 4]) and np.isnan(got).sum() == 1


def test_fitfc_against_loops(spark):
    im = series(np.random.default_rng(4), bands=1)
    o = fitfc.FitFCOptions(window=5, neighbors=4, resolution_factor=1, tile=5)
    got = grid(api.fitfc_job(pixels_of(spark, im), [3], 1, 12, 12, o), 12, 12, 1)[0]
    h1, l1, l2 = im["high", 1][0], im["low", 1][0], im["low", 3][0]
    value = np.zeros_like(h1)
    win = lambda a, y, x, r: a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].ravel()
    for y, x in np.ndindex(12, 12):
        a, b = win(l1, y, x, 2), win(l2, y, x, 2)
        det = len(a) * (a @ a) - a.sum() ** 2
        if abs(det) < 1e-14:
            value[y, x] = h1[y, x] + l2[y, x] - l1[y, x]
        else:
            g = (len(a) * (a @ b) - a.sum() * b.sum()) / det
            c = (b.sum() - g * a.sum()) / len(a)
            value[y, x] = np.clip(np.rint(g * h1[y, x] + c), 0, 255) + l2[y, x] - (g * l1[y, x] + c)
    for y, x in np.ndindex(12, 12):
        near = sorted((((h1[j, i] - h1[y, x]) ** 2, (j - y) ** 2 + (i - x) ** 2, j, i) for j in range(max(0, y - 2), min(12, y + 3)) for i in range(max(0, x - 2), min(12, x + 3))))[:4]
        w = [1 / (1 + 2 * math.sqrt(d) / 5) for _, d, *_ in near]
        mean = sum(a * value[j, i] for a, (*_, j, i) in zip(w, near)) / sum(w)
        assert abs(got[y, x] - np.clip(np.rint(mean), 0, 255)) <= (1 if abs(mean % 1 - 0.5) < 1e-6 else 0)


def test_regression_trust():
    f = estarfm.f_cdf(np.array([4.0, 161.4476, 0.0]), np.array([10.0, 1.0, 5.0]))
    assert f[0] == pytest.approx(0.926612, abs=1e-5) and f[1] == pytest.approx(0.95, abs=1e-5) and f[2] == 0
    x = np.arange(10.0)
    for y, want in ((2 * x + 1, 2.0), (-x, 1.0), (9 * x, 1.0), (np.ones(10), 0.0)):  # a constant has no F value, so its slope stands
        assert estarfm.slope(10, x.sum(), y.sum(), x @ x, x @ y, y @ y, False) == pytest.approx(want)
    noise = np.random.default_rng(0).normal(size=10) * 50
    assert estarfm.slope(10, x.sum(), noise.sum(), x @ x, x @ noise, noise @ noise, False) == 1


def test_options_are_checked():
    for wrong in (lambda: starfm.StarfmOptions(window=4), lambda: starfm.StarfmOptions(classes=0), lambda: fitfc.FitFCOptions(neighbors=0), lambda: estarfm.EstarfmOptions(window=0), lambda: interpolation.InterpolationOptions(limit_days=-1)):
        with pytest.raises(InvalidArgument):
            wrong()


def test_resampling_weights():
    for o in {o for o, *_ in fitfc.area_weights(10, 3)}:
        assert sum(w for q, _, w in fitfc.area_weights(10, 3) if q == o) == pytest.approx(1)
        assert sum(w for q, _, w in fitfc.cubic_weights(3, 10) if q == o) == pytest.approx(1)


@pytest.mark.parametrize("method", ["starfm", "fitfc", "estarfm"])
@pytest.mark.parametrize("mode", ["copy", "force", "ignore"])
def test_task(spark, method, mode):
    im = series(np.random.default_rng(5))
    im["low", 7] = im["low", 5]
    o = {"starfm": starfm.StarfmOptions(window=3, tile=8), "fitfc": fitfc.FitFCOptions(window=3, neighbors=2, resolution_factor=4, tile=8), "estarfm": estarfm.EstarfmOptions(window=3, tile=8)}[method]
    single = "ignore" if method == "estarfm" else "mixed"
    got, task = api.fusion_task(pixels_of(spark, im), [1, 3, 6, 7], 2, 12, 12, method, single, mode, o)
    cases = {r["date"]: r["pred_case"] for r in task.collect()}
    assert cases == {1: 4, 3: 1, 5: 0, 6: 3, 7: 2}
    dates = {3} | ({7} if single == "mixed" else set()) | ({1} if mode != "ignore" else set())
    assert {r[0] for r in got.select("date").distinct().collect()} == dates
    if mode == "copy":
        assert (grid(got.filter("date = 1"), 12, 12, 2) == im["high", 1]).all()


def test_planner_with_long_dates(spark):
    t = lambda *d: spark.createDataFrame([(x,) for x in d], "date int")
    task = planner.with_intervals(planner.task_table(t(2019234, 2019250), t(2019234, 2019240, 2019250, 2019260), t(2019240, 2019260)), "mixed")
    got = {r["date"]: (r["start_pair"], r["end_pair"], r["pred_case"]) for r in task.collect()}
    assert got[2019240] == (2019234, 2019250, 1) and got[2019260] == (2019250, 2019250, 2)
    assert planner.job_table(planner.with_intervals(planner.task_table(t(1), t(2), t()), "ignore")).count() == 0
    with pytest.raises(InvalidArgument):
        planner.check("spstfm", "ignore", "ignore")
    with pytest.raises(InvalidArgument):
        planner.check("estarfm", "all", "ignore")


# --- gap filling ---------------------------------------------------------------------------------
def test_linear_series_is_exact(spark):
    p = pixels_of(spark, {("a", d): np.full((1, 1, 2), 10.0 * d) for d in range(1, 9)})
    layers = spark.createDataFrame([("a", 3, 0, 0, True), ("", 5, 0, 0, True), ("", 1, 0, 1, True), ("", 2, 0, 1, True)], "tag string, date int, y int, x int, flag boolean")
    out, stats = api.imginterp_task(p, layers=layers, options=interpolation.InterpolationOptions(limit_days=2))
    got = {(r["date"], r["x"]): (r["value"], r["state"]) for r in out.collect()}
    assert got[3, 0] == (30.0, interpolation.FILLED) and got[5, 0] == (50.0, interpolation.FILLED) and got[4, 0] == (40.0, interpolation.CLEAR)
    assert got[1, 1] == (30.0, interpolation.FILLED)
    n = stats.agg(F.sum("n_values"), F.sum("n_interp_before"), F.sum("n_interp_after")).first()
    assert tuple(n) == (16, 4, 0)


def test_gap_beyond_the_limit(spark):
    p = pixels_of(spark, {("a", d): np.full((1, 1, 1), 10.0 * d) for d in (1, 5, 9)})
    o = interpolation.InterpolationOptions(limit_days=3)
    out, _ = api.imginterp_task(p, interp_ranges=IntervalSet.parse("[50,50]"), nodata=-1.0, options=o)
    got = {r["date"]: (r["value"], r["state"]) for r in out.collect()}
    assert got[5] == (-1.0, interpolation.LEFT_OUT) and got[9][1] == interpolation.CLEAR


def test_streamed_series_equals_the_batch():
    rng = random.Random(0)
    dates = list(range(1, 40))
    values, flags = [float(rng.randrange(100)) for _ in dates], [rng.random() < 0.4 for _ in dates]
    whole, _ = settle_series(dates, values, flags, 0, 3, True)
    seen, done = [], 0
    for i in range(1, len(dates) + 1):
        lo = max(0, i - 8)
        out, done = settle_series(dates[lo:i], values[lo:i], flags[lo:i], done, 3, i == len(dates))
        seen += out
    assert seen == whole and len(whole) == len(dates)


def test_stream_of_ended_pixels(spark, tmp_path):
    """A pixel without news gives what it still holds."""
    from tessera.streaming.gapfill import fill

    schema = "tag string, y int, x int, band int, date int, value double, flag boolean"
    rows = [("a", 0, 0, 0, d, 10.0 * d, d == 8) for d in range(1, 9)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fill(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, idle=1)
    q = stream.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("ended").filter("tag = 'a'").count() == 8:
                break
            q.awaitTermination(1)
            # a batch has to come for a timeout to be seen
            spark.createDataFrame([("b", 0, 0, 0, 1, 1.0, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        q.stop()
    got = {r["date"]: (r["value"], r["state"]) for r in spark.table("ended").filter("tag = 'a'").collect()}
    assert got[8] == (70.0, interpolation.FILLED) and set(got) == set(range(1, 9))


def test_stream(spark, tmp_path):
    from tessera.streaming.gapfill import fill

    rows = pd.DataFrame({"tag": "a", "y": 0, "x": 0, "band": 0, "date": range(1, 9), "value": [10.0 * d for d in range(1, 9)], "flag": [d == 4 for d in range(1, 9)]})
    schema = "tag string, y int, x int, band int, date int, value double, flag boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fill(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2)
    q = stream.writeStream.format("memory").queryName("filled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["date"]: (r["value"], r["state"]) for r in spark.table("filled").collect()}
    assert got[4] == (40.0, interpolation.FILLED) and set(got) == set(range(1, 7))
