"""STAARCH: where and when the land was disturbed, and prediction on either side of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.functions.intervals import IntervalSet

NEVER = 2**31 - 1
#: Band positions of the sensors.
MODIS = {"red": 0, "nir": 1, "blue": 2, "green": 3, "swir3": 4, "swir1": 5, "swir2": 6}
LANDSAT = {"blue": 0, "green": 1, "red": 2, "nir": 3, "swir1": 4, "swir2": 5}


@dataclass(frozen=True)
class StaarchOptions:
    clusters: int = 10
    average: int = 3
    direction: str = "forward"
    ratio: float = 2 / 3
    index: IntervalSet = field(default_factory=lambda: IntervalSet.parse("[2,inf)"))
    brightness: IntervalSet = field(default_factory=lambda: IntervalSet.parse("[-3,inf)"))
    greenness: IntervalSet = field(default_factory=IntervalSet.everything)
    wetness: IntervalSet = field(default_factory=lambda: IntervalSet.parse("(-inf,-1]"))
    ndvi: IntervalSet = field(default_factory=lambda: IntervalSet.parse("(-inf,0]"))
    diagonal: bool = False
    high_sensor: str = "landsat"
    low_sensor: str = "modis"
    bands: tuple[str, ...] = ("red", "green", "blue")


def standardize(cells: DataFrame, names: list[str], by: list[str], valid: Column | None = None) -> DataFrame:
    """(value - mean) / deviation of columns within groups; a deviation of 0 counts as 1.

    Means are aggregates, partial ones first, and join back as a row per group (an image,
    or a land class of one), so no image has to fit a task.  Invalid cells become null.
    """
    v = lambda n: F.col(n) if valid is None else F.when(valid, F.col(n))
    named = {n: f"_{n}" for n in by}
    stats = cells.groupBy(*[F.col(n).alias(k) for n, k in named.items()]).agg(*[f(v(n)).alias(f"_{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    same = F.lit(True)
    for n, k in named.items():
        same = same & F.col(n).eqNullSafe(F.col(k))
    joined = cells.join(F.broadcast(stats), same)
    scaled = {n: (v(n) - F.col(f"_mean_{n}")) / F.when(F.col(f"_std_{n}") == 0, 1.0).otherwise(F.col(f"_std_{n}")) for n in names}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in cells.columns])


INDICES = ["brightness", "greenness", "wetness", "ndvi"]


def raw_indices(cells: DataFrame, bands: list[str], sensor: str) -> DataFrame:
    """Tasselled cap and ndvi of the sensor's bands."""
    place = MODIS if sensor == "modis" else LANDSAT
    cols = [F.col(b).cast("double") for b in bands]
    for name, c in zip(INDICES, color.tasselled_cap(cols, sensor), strict=False):
        cells = cells.withColumn(name, c)
    return cells.withColumn("ndvi", color.difference_index(cols[place["nir"]], cols[place["red"]]))


def indices(cells: DataFrame, bands: list[str], sensor: str, by: list[str], valid: Column | None = None) -> DataFrame:
    """Standardised brightness, greenness, wetness and ndvi, and the disturbance index ``di``."""
    raw = standardize(raw_indices(cells, bands, sensor), INDICES, by, valid)
    return raw.withColumn("di", F.col("brightness") - F.col("greenness") - F.col("wetness"))


def with_neighbour(cells: DataFrame, hit: Column, keys: list[str], diagonal: bool = False) -> DataFrame:
    """``exceeds``: the cell is a hit and so is one of its 4 or 8 neighbours.  Dense rasters only."""
    df = cells.withColumn("_hit", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-1, 1)
    column = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-1, 1)
    df = df.withColumn("_row", F.sum("_hit").over(row))
    around = F.sum("_row").over(column) if diagonal else F.col("_row") + F.sum("_hit").over(column) - F.col("_hit")
    return df.withColumn("exceeds", (F.col("_hit") == 1) & (around - F.col("_hit") > 0)).drop("_hit", "_row")


def disturbed(cells: DataFrame, o: StaarchOptions, keys: list[str]) -> DataFrame:
    """``disturbed`` of one date: the index is in range with a neighbour, and all other indices are in theirs."""
    df = with_neighbour(cells, o.index.contains(F.col("di")), keys, o.diagonal)
    for name in ("brightness", "greenness", "wetness", "ndvi"):
        df = df.withColumn("exceeds", F.col("exceeds") & F.coalesce(getattr(o, name).contains(F.col(name)), F.lit(False)))
    return df.withColumnRenamed("exceeds", "disturbed")


def change_mask(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells undisturbed at the left date and disturbed at the right one."""
    a = left.select("y", "x", F.col("disturbed").alias("_before"))
    return right.select("y", "x", "disturbed").join(a, ["y", "x"]).select("y", "x", (F.col("disturbed") & ~F.col("_before")).alias("changed"))


def moving_average(series: DataFrame, n: int, direction: str) -> DataFrame:
    """Mean of n dates from each date on, up to it or around it, over valid ones; the value itself if there is none."""
    frame = {"forward": (0, n - 1), "backward": (1 - n, 0), "center": (-(n // 2), n // 2)}[direction]
    w = Window.partitionBy("y", "x").orderBy("date").rowsBetween(*frame)
    mean = F.avg(F.when(F.col("valid"), F.col("di"))).over(w)
    return series.select("y", "x", "date", F.coalesce(mean, F.col("di")).alias("di"), F.bool_or("valid").over(w).alias("valid"))


def threshold(series: DataFrame, ratio: float) -> DataFrame:
    """min + (max - min) ratio of each pixel's valid values."""
    v = F.when(F.col("valid"), F.col("di"))
    return series.groupBy("y", "x").agg((F.min(v) + (F.max(v) - F.min(v)) * ratio).alias("limit"))


def date_of_disturbance(series: DataFrame, changed: DataFrame, ratio: float) -> DataFrame:
    """The first valid date at or over the pixel's threshold where the land changed; NEVER elsewhere."""
    df = series.join(threshold(series, ratio), ["y", "x"]).join(changed, ["y", "x"])
    # nine places: an error of summation must not decide which of equal averages comes first
    hit = F.col("valid") & F.col("changed") & (F.round("di", 9) >= F.round("limit", 9))
    return df.groupBy("y", "x").agg(F.coalesce(F.min(F.when(hit, F.col("date"))), F.lit(NEVER)).cast("int").alias("dod"))


def land_classes(cells: DataFrame, bands: list[str], k: int, seed: int = 1, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Cells with ``land_class`` from k-means over bands; cells with a missing band get -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    known = cells.filter(" and ".join(f"{b} is not null" for b in bands))
    table = VectorAssembler(inputCols=bands, outputCol="_features").transform(known)
    model = KMeans(k=k, seed=seed, maxIter=iterations, tol=tolerance, featuresCol="_features", predictionCol="land_class").fit(table)
    named = model.transform(table).drop("_features")
    rest = cells.filter(" or ".join(f"{b} is null" for b in bands)).withColumn("land_class", F.lit(-1))
    return named.unionByName(rest)


def wide(pixels: DataFrame, tag: str, dates: list[int], count: int) -> DataFrame:
    """date, y, x, b0, b1, ... and valid (all bands are) of a tag's images."""
    some = pixels.filter((F.col("tag") == tag) & F.col("date").isin(dates))
    bands = [F.max(F.when(F.col("band") == i, F.col("value"))).alias(f"b{i}") for i in range(count)]
    ok = (F.count_if(F.col("valid") & F.col("value").isNotNull()) == count).alias("valid")
    return some.filter(F.col("band") < count).groupBy("date", "y", "x").agg(*bands, ok)


def disturbance(pixels: DataFrame, left: int, right: int, o: StaarchOptions, high: str = "high", classes: DataFrame | None = None) -> DataFrame:
    """y, x, changed: not disturbed in the left image and disturbed in the right one.

    Cells are standardised within their land class: given ones (y, x, land_class), or
    k-means of the left image's tasselled cap; within the image if there are fewer than two.
    """
    count = 7 if o.high_sensor == "modis" else 6
    names = [f"b{i}" for i in range(count)]
    images = wide(pixels, high, [left, right], count)
    both = images.groupBy("y", "x").agg((F.count_if("valid") == 2).alias("_both"))
    raw = raw_indices(images, names, o.high_sensor).join(both, ["y", "x"])
    if classes is None and o.clusters >= 2:
        first = raw.filter(F.col("date") == left).select("y", "x", *[F.when(F.col("_both"), F.col(n)).alias(n) for n in INDICES[:3]])
        classes = land_classes(first, INDICES[:3], o.clusters).select("y", "x", "land_class")
    if classes is None:
        raw = raw.withColumn("land_class", F.lit(0))
    else:
        raw = raw.join(classes, ["y", "x"], "left")
    counted = F.col("_both") & (F.coalesce("land_class", F.lit(-1)) >= 0)
    std = standardize(raw, INDICES, ["date", "land_class"], counted).withColumn("di", F.col("brightness") - F.col("greenness") - F.col("wetness"))
    found = disturbed(std, o, ["date"]).select("date", "y", "x", "disturbed")
    return change_mask(found.filter(F.col("date") == left), found.filter(F.col("date") == right))


def low_series(pixels: DataFrame, dates: list[int], o: StaarchOptions, low: str = "low") -> DataFrame:
    """y, x, date, di, valid of the low resolution images, each standardised by itself, averaged over dates."""
    count = 7 if o.low_sensor == "modis" else 6
    images = wide(pixels, low, dates, count)
    di = indices(images, [f"b{i}" for i in range(count)], o.low_sensor, ["date"], F.col("valid")).select("y", "x", "date", "di", "valid")
    # a window of one image, or of two around one, is the image itself
    return di if o.average <= 1 or (o.average == 2 and o.direction == "center") else moving_average(di, o.average, o.direction)


def output_bands(pixels: DataFrame, o: StaarchOptions, high: str = "high", low: str = "low") -> DataFrame:
    """The bands to predict, numbered alike for both sensors."""
    number = F.lit(None).cast("int")
    for tag, sensor in ((high, o.high_sensor), (low, o.low_sensor)):
        place = MODIS if sensor == "modis" else LANDSAT
        for i, name in enumerate(o.bands):
            number = F.when((F.col("tag") == tag) & (F.col("band") == place[name]), i).otherwise(number)
    return pixels.withColumn("band", number).filter("band is not null")


def merge_predictions(double: DataFrame, left: DataFrame, right: DataFrame, dod: DataFrame) -> DataFrame:
    """Undisturbed cells from both pairs, disturbed ones from the pair on their side of the event."""
    keys = ["pred_date", "y", "x", "band"]
    df = double.join(left.withColumnRenamed("value", "_l"), keys).join(right.withColumnRenamed("value", "_r"), keys).join(dod, ["y", "x"])
    value = F.when(F.col("dod") == NEVER, F.col("value")).when(F.col("dod") > F.col("pred_date"), F.col("_l")).otherwise(F.col("_r"))
    return df.select(*keys, value.alias("value"))
