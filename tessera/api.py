"""The public functions: three fusion jobs, the task over them, and gap filling.

All take and return pixels; every prediction of a call is one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument, NotFound, SizeError
from tessera.functions import masks
from tessera.functions.intervals import IntervalSet, ordered_set
from tessera.operators import aggregates, estarfm, fitfc, interpolation, staarch, starfm
from tessera.plans import planner

KEYS = ["pred_date", "y", "x", "band"]
Steps = list[tuple[str, IntervalSet]]


@dataclass(frozen=True)
class JobMasks:
    """What narrows the validity of a job's images.

    ``images`` are mask tables (y, x, valid, and band if bands differ), all of which must
    hold; a cell a mask doesn't have is invalid.  ``ranges`` are ordered ("valid" or
    "invalid", set) steps for both tags, ``high_ranges`` and ``low_ranges`` for one;
    ``nodata`` is each tag's value for missing data.
    """

    images: tuple[DataFrame, ...] = ()
    ranges: Steps | None = None
    high_ranges: Steps | None = None
    low_ranges: Steps | None = None
    nodata: dict[str, float] | None = None
    integral: bool = True


def _jobs_of(jobs: DataFrame) -> list[tuple[int, int, int | None]]:
    """date, date1, date3: a row per predicted image."""
    return sorted((r["date"], r["date1"], r["date3"]) for r in jobs.select("date", "date1", "date3").collect())


def align_jobs(pixels: DataFrame, jobs: DataFrame, double: bool, high: str = "high", low: str = "low", grid: tuple[int, int, int] | None = None) -> DataFrame:
    """Rows per pred_date, y, x and band with h1, l1, l2 (h3, l3) and ok for all jobs (date, date1, date3).

    One shuffle brings all images of all jobs together by cell; jobs are laid out after
    it.  A cell that an image lacks has a null there and is not ok.  With a ``grid``
    (height, width, bands) every one of its cells has a row.
    """
    rows = _jobs_of(jobs)
    if not rows:
        columns = ["l2", "h1", "l1", *(["h3", "l3"] if double else [])]
        return pixels.filter("false").select(F.lit(0).alias("pred_date"), "y", "x", "band", *[F.col("value").alias(c) for c in columns], F.lit(False).alias("ok"))
    roles = [{"l2": (low, d), "h1": (high, a), "l1": (low, a)} | ({"h3": (high, b), "l3": (low, b)} if double else {}) for d, a, b in rows]
    images = sorted({i for r in roles for i in r.values()})
    here = lambda t, d: (F.col("tag") == t) & (F.col("date") == d)
    cells = pixels.filter(reduce(lambda a, b: a | b, (here(*i) for i in images))).select("tag", "date", "y", "x", "band", "value", "valid")
    if grid is not None:
        height, width, bands = grid
        n = F.col("id")
        empty = pixels.sparkSession.range(height * width * bands).select(
            F.lit(None).cast("string").alias("tag"), F.lit(None).cast("int").alias("date"), (F.floor(n / (width * bands))).cast("int").alias("y"), (F.floor(n / bands) % width).cast("int").alias("x"), (n % bands).cast("int").alias("band"),
            F.lit(None).cast("double").alias("value"), F.lit(False).alias("valid"),
        )
        cells = cells.unionByName(empty)
    name = {i: f"_{n}" for n, i in enumerate(images)}
    values = [F.max(F.when(here(*i), F.col("value"))).alias(name[i]) for i in images]
    valid = [F.max(F.when(here(*i), F.col("valid") & F.col("value").isNotNull())).alias(f"{name[i]}v") for i in images]
    together = cells.groupBy("y", "x", "band").agg(*values, *valid)
    laid = []
    for (d, _, _), role in zip(rows, roles, strict=True):
        ok = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"{name[i]}v"), F.lit(False)) for i in role.values()))
        laid.append(F.struct(F.lit(d).alias("pred_date"), *[F.col(name[i]).alias(c) for c, i in role.items()], ok.alias("ok")))
    out = together.select("y", "x", "band", F.explode(F.array(*laid)).alias("j"))
    return out.select("j.pred_date", "y", "x", "band", *[f"j.{c}" for c in roles[0]], "j.ok")


def use_ranges(pixels: DataFrame, tag: str, steps: Steps, integral: bool = True) -> DataFrame:
    """Narrow the validity of a tag's images by ordered valid and invalid ranges; no ranges, no change."""
    if not steps:
        return pixels
    wanted = ordered_set(steps)
    test = (wanted.discrete() if integral else wanted).contains(F.col("value"))
    return pixels.withColumn("valid", F.col("valid") & F.when(F.col("tag") == tag, test).otherwise(F.lit(True)))


def use_nodata(pixels: DataFrame, nodata: dict[str, float]) -> DataFrame:
    """Each tag's own missing value is invalid."""
    test = F.lit(True)
    for tag, value in nodata.items():
        test = test & ~((F.col("tag") == tag) & (F.col("value") == value))
    return pixels.withColumn("valid", F.col("valid") & test)


def narrowed(pixels: DataFrame, job: JobMasks | None, high: str, low: str) -> DataFrame:
    """Pixels with the ranges and missing values of a job; mask images come after alignment."""
    if job is None:
        return pixels
    for tag, own in ((high, job.high_ranges), (low, job.low_ranges)):
        pixels = use_ranges(pixels, tag, [*(job.ranges or []), *(own or [])], job.integral)
    return use_nodata(pixels, job.nodata or {})


def masked(aligned: DataFrame, job: JobMasks | None) -> DataFrame:
    for mask in job.images if job else ():
        aligned = masks.combine(aligned.withColumnRenamed("ok", "valid"), mask.select(*[c for c in ("y", "x", "band", "valid") if c in mask.columns])).withColumnRenamed("valid", "ok")
    return aligned


def check_sizes(pixels: DataFrame, jobs: DataFrame, double: bool, high: str, low: str) -> None:
    """All images of the jobs are there and of one size; one row per image comes to the driver."""
    rows = _jobs_of(jobs)
    wanted = {(t, d) for p, a, b in rows for t, d in ((low, p), (high, a), (low, a), *(((high, b), (low, b)) if double else ()))}
    sizes = pixels.filter(F.col("date").isin(sorted({d for _, d in wanted})) & F.col("tag").isin(high, low)).groupBy("tag", "date").agg(F.max("y").alias("h"), F.max("x").alias("w"), F.max("band").alias("b")).collect()
    found = {(r["tag"], r["date"]): (r["h"], r["w"], r["b"]) for r in sizes if (r["tag"], r["date"]) in wanted}
    if missing := sorted(wanted - set(found)):
        raise NotFound(f"no image {missing[0][0]!r} of {missing[0][1]}")
    if len(set(found.values())) > 1:
        raise SizeError(f"images of different sizes: {sorted(set(found.values()))}")


def _labelled(out: DataFrame) -> DataFrame:
    return out.select(F.lit("predicted").alias("tag"), F.col("pred_date").alias("date"), "y", "x", "band", "value", F.col("value").isNotNull().alias("valid"))


def _mask_of(aligned: DataFrame) -> DataFrame:
    """The mask of each prediction: cells valid in all its images and masks."""
    return aligned.select(F.lit("mask").alias("tag"), F.col("pred_date").alias("date"), "y", "x", "band", F.col("ok").alias("valid"))


def _banded(aligned: DataFrame, names: list[str]) -> DataFrame:
    return aligned.groupBy("pred_date", "y", "x").agg(*[estarfm.by_band(n).alias(n) for n in names])


def _jobs(pixels: DataFrame, dates: list[int], date1: int | None, date3: int | None, high: str, low: str, double: bool | None) -> tuple[DataFrame, bool]:
    """Pair dates given or found: first and last date both tags have."""
    if not dates:
        raise InvalidArgument("no date to predict")
    if date1 is None:
        have = lambda t: pixels.filter(F.col("tag") == t).select("date").distinct()
        row = have(high).intersect(have(low)).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        if row["a"] is None:
            raise NotFound("no pair of images")
        date1, last = row["a"], row["b"]
        if date3 is None and last != date1 and not (any(d > last for d in dates) and any(d < date1 for d in dates)):
            date3 = last
    two = date3 is not None if double is None else double
    if two and date3 is None:
        raise InvalidArgument("two pairs are asked for and there is one")
    rows = [(d, date1, date3 if two else None) for d in dates]
    return pixels.sparkSession.createDataFrame(rows, "date int, date1 int, date3 int"), two


def _aligned(pixels: DataFrame, jobs: DataFrame, double: bool, high: str, low: str, job: JobMasks | None, check: bool, grid: tuple[int, int, int] | None = None) -> DataFrame:
    if check:
        check_sizes(pixels, jobs, double, high, low)
    return masked(align_jobs(narrowed(pixels, job, high, low), jobs, double, high, low, grid), job)


def starfm_job(pixels: DataFrame, dates: list[int], options: starfm.StarfmOptions = starfm.StarfmOptions(), date1: int | None = None, date3: int | None = None, double: bool | None = None, high: str = "high", low: str = "low", job_masks: JobMasks | None = None, output_masks: bool = False, check: bool = True):
    """Predictions of all dates; with ``output_masks`` (predictions, masks)."""
    jobs, two = _jobs(pixels, dates, date1, date3, high, low, double)
    aligned = _aligned(pixels, jobs, two, high, low, job_masks, check)
    out = _labelled(starfm.predict(aligned, options, two))
    return (out, _mask_of(aligned)) if output_masks else out


def estarfm_job(pixels: DataFrame, dates: list[int], bands: int, options: estarfm.EstarfmOptions | None = None, date1: int | None = None, date3: int | None = None, high: str = "high", low: str = "low", job_masks: JobMasks | None = None, output_masks: bool = False, check: bool = True):
    """Predictions of all dates; with ``output_masks`` (predictions, masks)."""
    options = options or estarfm.EstarfmOptions(classes=64 ** (1 / bands))
    jobs, _ = _jobs(pixels, dates, date1, date3, high, low, True)
    aligned = _aligned(pixels, jobs, True, high, low, job_masks, check)
    out = _labelled(_exploded(estarfm.predict(_banded(aligned, ["h1", "h3", "l1", "l3", "l2", "ok"]), bands, options)))
    return (out, _mask_of(aligned)) if output_masks else out


def fitfc_job(pixels: DataFrame, dates: list[int], bands: int, height: int, width: int, options: fitfc.FitFCOptions = fitfc.FitFCOptions(), date1: int | None = None, date3: int | None = None, high: str = "high", low: str = "low", job_masks: JobMasks | None = None, output_masks: bool = False, check: bool = True):
    """Predictions of all dates from the pair of ``date1`` and, if there is a second, from that of ``date3``.

    ``pair`` names the pair's date.  With ``output_masks`` (predictions, masks).
    """
    jobs, _ = _jobs(pixels, dates, date1, date3, high, low, None if date1 is None and date3 is None else date3 is not None)
    first = _jobs_of(jobs)[0]
    parts, kept = [], []
    for pair in dict.fromkeys(d for d in first[1:] if d is not None):
        own = jobs.select("date", F.lit(pair).alias("date1"), F.lit(None).cast("int").alias("date3"))
        aligned = _aligned(pixels, own, False, high, low, job_masks, check, (height, width, bands))
        parts.append(_labelled(_exploded(fitfc.predict(aligned, bands, height, width, options))).withColumn("pair", F.lit(pair)))
        kept.append(_mask_of(aligned).withColumn("pair", F.lit(pair)))
    out, mask = (reduce(DataFrame.unionByName, x) for x in (parts, kept))
    return (out, mask) if output_masks else out


def _exploded(out: DataFrame) -> DataFrame:
    return out.select("pred_date", "y", "x", F.posexplode("value").alias("band", "value"))


def fusion_task(
    pixels: DataFrame,
    dates: list[int],
    bands: int,
    height: int,
    width: int,
    method: str = "starfm",
    singlepair_mode: str = "ignore",
    high_date_prediction_mode: str = "ignore",
    options=None,
    high: str = "high",
    low: str = "low",
    job_masks: JobMasks | None = None,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Predict all dates that can be; returns pixels of predictions and the task table.

    ``pair`` is the date of the pair a prediction comes from where a method takes one pair
    and two are there (Fit-FC, one prediction from each); null otherwise.
    """
    planner.check(method, singlepair_mode, high_date_prediction_mode)
    spark = pixels.sparkSession
    have = lambda t: pixels.filter(F.col("tag") == t).select("date").distinct()
    task = planner.with_intervals(planner.task_table(have(high), have(low), spark.createDataFrame([(d,) for d in dates], "date int")), singlepair_mode)
    jobs = planner.job_map(task, singlepair_mode)
    none = F.lit(None).cast("int")
    parts = []

    def add(source: DataFrame, some: DataFrame, double: bool, pair: Column = none) -> None:
        out = _run(source, some, double, method, bands, height, width, options, high, low, job_masks, check)
        parts.append(out.withColumn("pair", pair))

    two, one = jobs.filter("date3 is not null"), jobs.filter("date3 is null")
    if method == "fitfc":
        for side in ("date1", "date3"):
            own = two.select("date", F.col(side).alias("date1"), none.alias("date3"))
            # dates of one pair share an interval, so each pair is a job of its own
            for pair in sorted({r[0] for r in own.select("date1").distinct().collect()}):
                add(pixels, own.filter(F.col("date1") == pair), False, F.lit(pair))
    else:
        add(pixels, two, True)
    if method != "estarfm":
        add(pixels, one, False)
    if high_date_prediction_mode == "copy":
        parts.append(planner.copy_high(pixels, task.filter("pred_case in (4, 5)"), high).select("tag", "date", "y", "x", "band", "value", "valid", none.alias("pair")))
    elif high_date_prediction_mode == "force":
        # the image stands for the high and the low side of a pair with itself
        own = planner.high_dates(task, "force").select("date", F.col("date").alias("date1"), F.col("date").alias("date3"))
        mirror = pixels.filter(F.col("tag") == high).unionByName(pixels.filter(F.col("tag") == high).withColumn("tag", F.lit(low)))
        add(mirror, own, method == "estarfm")
    return reduce(DataFrame.unionByName, parts), task


def _run(pixels: DataFrame, jobs: DataFrame, double: bool, method: str, bands: int, height: int, width: int, options, high: str, low: str, job_masks: JobMasks | None = None, check: bool = True) -> DataFrame:
    grid = (height, width, bands) if method == "fitfc" else None
    aligned = _aligned(pixels, jobs, double, high, low, job_masks, check, grid)
    if method == "starfm":
        return _labelled(starfm.predict(aligned, options or starfm.StarfmOptions(), double))
    if method == "estarfm":
        o = options or estarfm.EstarfmOptions(classes=64 ** (1 / bands))
        return _labelled(_exploded(estarfm.predict(_banded(aligned, ["h1", "h3", "l1", "l3", "l2", "ok"]), bands, o)))
    return _labelled(_exploded(fitfc.predict(aligned, bands, height, width, options or fitfc.FitFCOptions())))


def staarch_job(
    pixels: DataFrame,
    dates: list[int],
    left: int,
    right: int,
    options: staarch.StaarchOptions = staarch.StaarchOptions(),
    starfm_options: starfm.StarfmOptions = starfm.StarfmOptions(),
    high: str = "high",
    low: str = "low",
    classes: DataFrame | None = None,
    job_masks: JobMasks | None = None,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Predictions between two dates with both images, and y, x, dod, the dates of disturbance.

    Undisturbed cells are predicted from both pairs; a disturbed one from the left pair
    before its date and from the right pair from it on.
    """
    if not dates or any(not left <= d <= right for d in dates):
        raise InvalidArgument("dates to predict lie between the pairs")
    pixels = narrowed(pixels, job_masks, high, low)
    for mask in job_masks.images if job_masks else ():
        pixels = masks.combine(pixels, mask.select(*[c for c in ("y", "x", "band", "valid") if c in mask.columns]))
    between = sorted(r[0] for r in pixels.filter((F.col("tag") == low) & F.col("date").between(left, right)).select("date").distinct().collect())
    changed = staarch.disturbance(pixels, left, right, options, high, classes)
    dod = staarch.date_of_disturbance(staarch.low_series(pixels, between, options, low), changed, options.ratio)
    source = staarch.output_bands(pixels, options, high, low)
    plan = pixels.sparkSession.createDataFrame([(d,) for d in dates], "date int")
    at = dod.crossJoin(F.broadcast(plan.withColumnRenamed("date", "pred_date")))  # a row per predicted image
    parts = []
    for double, pair, cells in ((True, left, F.col("dod") == staarch.NEVER), (False, left, (F.col("dod") < staarch.NEVER) & (F.col("dod") > F.col("pred_date"))), (False, right, F.col("dod") <= F.col("pred_date"))):
        jobs = plan.select("date", F.lit(pair).alias("date1"), F.lit(right if double else None).cast("int").alias("date3"))
        aligned = _aligned(source, jobs, double, high, low, None, check)
        only = at.filter(cells).select("pred_date", "y", "x")
        own = replace(starfm_options, temporal_weight=double) if starfm_options.temporal_weight is None else starfm_options
        parts.append(starfm.predict(aligned, own, double, only=only))
    return _labelled(reduce(DataFrame.unionByName, parts)), dod


def imginterp_task(
    pixels: DataFrame,
    interp_ranges: IntervalSet = IntervalSet(),
    valid_steps: Steps | None = None,
    layers: DataFrame | None = None,
    mask_layers: DataFrame | None = None,
    nodata: float | None = None,
    options: interpolation.InterpolationOptions = interpolation.InterpolationOptions(),
    only_layered: bool = False,
    choose_nodata: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fill gaps; returns pixels with states, and counts per image.

    ``layers`` (tag, date, y, x, flag) ask for interpolation, ``mask_layers`` (tag,
    date, y, x, mask) are AND-ed into the validity; an empty tag holds for all tags.
    With ``only_layered`` only dates that a layer covers are given back, though all
    dates lend values.  ``choose_nodata`` finds each tag a value that none of its
    remaining cells has, where ``nodata`` names none; a tag without a free one keeps
    its cells as they were, as their state tells.
    """
    df = pixels
    for name, table, fold in (("flag", layers, "or"), ("mask", mask_layers, "and")):
        df = df.withColumn(name, F.lit(fold == "and")) if table is None else interpolation.layer_flags(df, table, name, fold)
    valid: Column = F.col("valid") & F.col("mask")
    if valid_steps:
        valid = valid & ordered_set(valid_steps).contains(F.col("value"))
    if nodata is not None:
        valid = valid & (F.col("value") != nodata)
    df = df.withColumn("valid", valid)
    out = interpolation.interpolate(df, F.col("flag") | interp_ranges.contains(F.col("value")), replace(options, nodata=nodata))
    if only_layered:
        named = layers.select("tag", "date").distinct() if layers is not None else pixels.filter("false").select("tag", "date")
        own, every = named.filter("tag <> ''"), named.filter("tag = ''").select("date").distinct()
        # a row per image
        out = out.join(F.broadcast(own.withColumn("_own", F.lit(True))), ["tag", "date"], "left").join(F.broadcast(every.withColumn("_all", F.lit(True))), "date", "left").filter("_own or _all").select("tag", "date", "y", "x", "band", "value", "state")
    if choose_nodata and nodata is None:
        out = aggregates.with_nodata(out, options.dtype)
    return out, interpolation.statistics(out)
