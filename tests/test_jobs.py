"""Jobs as users call them: sizes, masks, both pairs, dates with layers, values for missing data, disturbance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.errors import InvalidArgument, NotFound, SizeError
from tessera.functions.intervals import IntervalSet
from tessera.operators import fitfc, interpolation, staarch, starfm
from tests.test_raster import grid, pixels_of, series


def test_sizes_are_checked(spark):
    im = series(np.random.default_rng(0))
    im["low", 5] = im["low", 5][:, :, :9]
    p = pixels_of(spark, im)
    o = starfm.StarfmOptions(window=3, tile=8)
    with pytest.raises(SizeError):
        api.starfm_job(p, [3], o, 1, 5)
    with pytest.raises(NotFound):
        api.starfm_job(p, [4], o, 1, double=False)
    with pytest.raises(NotFound):
        api.fitfc_job(p, [3], 2, 12, 12, fitfc.FitFCOptions(window=3), 2)
    assert api.starfm_job(p, [3], o, 1, double=False).count() == 288


def test_cells_that_an_image_lacks_are_empty(spark):
    """An image without some rows leaves those cells without a prediction, not the others."""
    im = series(np.random.default_rng(1))
    p = pixels_of(spark, im).filter("not (tag = 'low' and date = 3 and y = 4 and x < 6)")
    out, mask = api.starfm_job(p, [3], starfm.StarfmOptions(window=3, tile=8), 1, double=False, output_masks=True)
    got = grid(out, 12, 12, 2)
    assert np.isnan(got[:, 4, :6]).all() and np.isnan(got).sum() == 12
    assert mask.filter("not valid").count() == 12 and mask.count() == 288
    got = grid(api.fitfc_job(p, [3], 2, 12, 12, fitfc.FitFCOptions(window=3, neighbors=2, resolution_factor=1, tile=8), 1), 12, 12, 2)
    assert np.isnan(got[:, 4, :6]).all() and np.isnan(got).sum() == 12


def test_masks_narrow_a_job(spark):
    im = series(np.random.default_rng(2))
    p = pixels_of(spark, im)
    rows = [(y, x, (y + x) % 4 != 0) for y in range(12) for x in range(12)]
    mask = spark.createDataFrame(rows, "y int, x int, valid boolean")
    high = float(im["high", 1][0, 2, 3])
    job = api.JobMasks((mask,), low_ranges=[("invalid", IntervalSet.parse("[0,30]"))], nodata={"high": high})
    _, told = api.starfm_job(p, [3], starfm.StarfmOptions(window=3, tile=8), 1, double=False, job_masks=job, output_masks=True)
    for r in told.collect():
        b, y, x = r["band"], r["y"], r["x"]
        want = (y + x) % 4 != 0 and im["high", 1][b, y, x] != high and im["low", 1][b, y, x] > 30 and im["low", 3][b, y, x] > 30
        assert r["valid"] == want


def test_task_gives_both_pairs_of_fitfc(spark):
    im = series(np.random.default_rng(3))
    o = fitfc.FitFCOptions(window=3, neighbors=2, resolution_factor=1, tile=8)
    p = pixels_of(spark, im)
    got, _ = api.fusion_task(p, [3], 2, 12, 12, "fitfc", options=o)
    assert {r["pair"]: r["n"] for r in got.groupBy("pair").agg(F.count("*").alias("n")).collect()} == {1: 288, 5: 288}
    for pair in (1, 5):
        own = api.fitfc_job(p, [3], 2, 12, 12, o, pair).drop("pair")
        assert own.exceptAll(got.filter(F.col("pair") == pair).drop("pair")).count() == 0


def test_only_dates_with_a_layer(spark):
    p = pixels_of(spark, {(t, d): np.full((1, 1, 2), 10.0 * d) for t in "ab" for d in range(1, 6)})
    layers = spark.createDataFrame([("a", 3, 0, 0, True), ("", 5, 0, 1, True)], "tag string, date int, y int, x int, flag boolean")
    o = interpolation.InterpolationOptions(limit_days=2)
    out, stats = api.imginterp_task(p, layers=layers, options=o, only_layered=True)
    assert {tuple(r) for r in out.select("tag", "date").distinct().collect()} == {("a", 3), ("a", 5), ("b", 5)} and stats.count() == 3
    assert out.filter("tag = 'a' and date = 3 and x = 0").first()["value"] == 30.0
    assert api.imginterp_task(p, options=o, only_layered=True)[0].count() == 0


def test_a_free_value_stands_for_missing_data(spark):
    rows = [("full", d, 0, x, 0, float(x % 256), not (d == 1 and x == 7)) for d in (1, 9) for x in range(256)]
    rows += [("some", d, 0, x, 0, float(x), x != 3) for d in (1, 9) for x in range(5)]
    p = spark.createDataFrame(rows, "tag string, date int, y int, x int, band int, value double, valid boolean")
    o = interpolation.InterpolationOptions(limit_days=1, dtype="uint8")
    out, _ = api.imginterp_task(p, options=o, choose_nodata=True)
    got = {(r["tag"], r["date"], r["x"]): (r["value"], r["state"]) for r in out.collect()}
    assert got["some", 1, 3] == (255.0, interpolation.LEFT_OUT) and got["some", 9, 3][0] == 255.0 and got["some", 1, 2] == (2.0, interpolation.CLEAR)
    assert got["full", 1, 7] == (7.0, interpolation.LEFT_OUT)


def test_disturbance_from_images_to_prediction(spark):
    """A patch that is cleared at date 4: found in place and time, and predicted from the pair on its side."""
    rng = np.random.default_rng(5)
    n = 24
    # forest: dark and green; cleared land: bright and dry
    forest, bare = np.array([20, 30, 25, 120, 60, 30.0]), np.array([90, 100, 120, 140, 160, 150.0])
    patch = np.zeros((n, n), bool)
    patch[8:14, 10:17] = True
    order = [2, 3, 0, 1, 4, 4, 5]  # bands of the other sensor, made of these

    def image(cleared, bands):
        base = np.where(cleared[None], bare[:, None, None], forest[:, None, None])[bands]
        return np.rint(base + rng.normal(0, 1, base.shape))

    im = {("high", d): image(patch & (d >= 4), list(range(6))) for d in (1, 7)}
    im |= {("low", d): image(patch & (d >= 4), order) for d in range(1, 8)}
    p = pixels_of(spark, im)
    o = staarch.StaarchOptions(clusters=1, average=1, index=IntervalSet.parse("[1,inf)"), brightness=IntervalSet.everything(), wetness=IntervalSet.everything(), ndvi=IntervalSet.everything())
    out, dod = api.staarch_job(p, [3, 5], 1, 7, o, starfm.StarfmOptions(window=5, tile=16))
    told = {(r["y"], r["x"]): r["dod"] for r in dod.collect()}
    assert all((told[y, x] == 4) == patch[y, x] for y in range(n) for x in range(n)) and sorted(set(told.values())) == [4, staarch.NEVER]
    got = {d: grid(out.filter(F.col("date") == d), n, n, 3) for d in (3, 5)}
    for b, high in enumerate((2, 1, 0)):  # red, green, blue of the high sensor
        assert np.abs(got[3][b][patch] - forest[high]).max() < 12 and np.abs(got[5][b][patch] - bare[high]).max() < 12
        assert np.abs(got[3][b][~patch] - forest[high]).max() < 12
    with pytest.raises(InvalidArgument):
        api.staarch_job(p, [9], 1, 7, o)


def test_land_classes_given_and_found(spark):
    """Standardising within classes hides what tells classes apart, so only change within one counts."""
    n = 16
    left = np.zeros((6, n, n)) + np.array([20, 30, 25, 120, 60, 30.0])[:, None, None] + np.random.default_rng(1).normal(0, 1, (6, n, n))
    left[:, :, 8:] += 60  # another kind of land
    right = left.copy()
    right[:, 4:7, 3:6] += np.array([60, 60, 80, 0, 90, 100.0])[:, None, None]
    p = pixels_of(spark, {("high", 1): left, ("high", 7): right})
    o = staarch.StaarchOptions(clusters=2, index=IntervalSet.parse("[5,inf)"), brightness=IntervalSet.everything(), wetness=IntervalSet.everything(), ndvi=IntervalSet.everything())
    classes = spark.createDataFrame([(y, x, int(x >= 8)) for y in range(n) for x in range(n)], "y int, x int, land_class int")
    for given in (classes, None):
        found = {(r["y"], r["x"]) for r in staarch.disturbance(p, 1, 7, o, classes=given).filter("changed").collect()}
        assert found == {(y, x) for y in range(4, 7) for x in range(3, 6)}
