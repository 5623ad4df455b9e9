"""Fit-FC: regression mapping, residual compensation and spatial filtering from one pair."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument, SizeError
from tessera.functions.geo import Rectangle
from tessera.model import base_type, saturate
from tessera.operators.estarfm import by_band
from tessera.operators.neighborhood import TILE, Tile, box_sum, by_tile


@dataclass(frozen=True)
class FitFCOptions:
    window: int = 51
    neighbors: int = 10
    resolution_factor: float = 30
    dtype: str = "uint8"
    area: Rectangle | None = None
    tile: int = TILE

    def __post_init__(self) -> None:
        if self.window < 1 or self.window % 2 == 0:
            raise InvalidArgument("the window must be odd")
        if self.neighbors < 1 or self.resolution_factor < 1:
            raise InvalidArgument("neighbors and resolution_factor start at 1")
        base_type(self.dtype)


def regression(aligned: DataFrame, options: FitFCOptions) -> DataFrame:
    """frm and residual per cell: low date 2 regressed on low date 1 over the window, applied to high date 1."""
    ok = F.col("ok")
    v = lambda c: F.when(ok, c)
    a, b = F.col("l1"), F.col("l2")
    sums = {"n": F.when(ok, 1.0).otherwise(0.0), "sx": v(a), "sy": v(b), "sxx": v(a * a), "sxy": v(a * b)}
    df = box_sum(aligned, options.window // 2, sums, ["pred_date", "band"])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = F.abs(det) < 1e-14
    gain = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), det)
    shift = F.try_divide(F.col("sy") - gain * F.col("sx"), F.col("n"))
    df = df.withColumn("_a", F.when(flat, 1.0).otherwise(gain)).withColumn("_b", F.when(flat, 0.0).otherwise(shift))
    # nine places: an error of summation must not decide how a half is rounded
    frm = F.when(flat, F.col("h1")).otherwise(saturate(F.round(F.col("_a") * F.col("h1") + F.col("_b"), 9), options.dtype))
    return df.select(*aligned.columns, v(frm).alias("frm"), v(b - (F.col("_a") * a + F.col("_b"))).alias("residual"))


def area_weights(size: int, factor: float) -> list[tuple[int, int, float]]:
    """(out, in, weight) of area averaging by a factor."""
    m = max(1, round(size / factor))
    step = size / m
    out = []
    for o in range(m):
        for i in range(math.floor(o * step), min(size, math.ceil((o + 1) * step))):
            w = min(i + 1, (o + 1) * step) - max(i, o * step)
            if w > 1e-9:
                out.append((o, i, w / step))
    return out


def cubic_weights(size: int, target: int, a: float = -0.75) -> list[tuple[int, int, float]]:
    """(out, in, weight) of bicubic enlargement; the border repeats."""
    near = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1
    far = lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    out: dict[tuple[int, int], float] = {}
    for o in range(target):
        s = (o + 0.5) * size / target - 0.5
        base = math.floor(s)
        t = s - base
        for k, w in ((-1, far(t + 1)), (0, near(t)), (1, near(1 - t)), (2, far(2 - t))):
            key = (o, min(max(base + k, 0), size - 1))
            out[key] = out.get(key, 0.0) + w
    return [(o, i, w) for (o, i), w in out.items()]


def resample(cells: DataFrame, column: str, down: list[tuple[int, int, float]], across: list[tuple[int, int, float]], keys: list[str]) -> DataFrame:
    """Linear resampling by weight tables for y and x, one axis after the other.

    Missing cells are left out and the weights of the others renewed at the end.
    """
    known = F.col(column).isNotNull()
    part = cells.select(*keys, "y", "x", F.coalesce(column, F.lit(0.0)).alias("_v"), F.when(known, 1.0).otherwise(0.0).alias("_n"))
    for axis, weights in (("y", down), ("x", across)):
        table = F.broadcast(cells.sparkSession.createDataFrame(weights, "_out int, _in int, _w double"))  # image side x 5 rows
        other = "x" if axis == "y" else "y"
        joined = part.join(table, F.col(axis) == F.col("_in"))
        part = joined.groupBy(*keys, F.col("_out").alias(axis), other).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in ("_v", "_n")])
    return part.select(*keys, "y", "x", F.try_divide(F.col("_v"), F.col("_n")).alias(column))


def smooth_residual(cells: DataFrame, height: int, width: int, factor: float) -> DataFrame:
    """Residuals averaged down by the factor and enlarged again by bicubic interpolation."""
    keys = ["pred_date", "band"]
    r = cells.select(*keys, "y", "x", "residual")
    if factor == 1:
        return r
    if min(height, width) < factor:
        raise SizeError("the image is smaller than the resolution factor")
    down_y, down_x = area_weights(height, factor), area_weights(width, factor)
    small = resample(r, "residual", down_y, down_x, keys)
    my, mx = max(o for o, *_ in down_y) + 1, max(o for o, *_ in down_x) + 1
    return resample(small, "residual", cubic_weights(my, height), cubic_weights(mx, width), keys)


#: Cells whose neighbours are ranked together; bounds the table of scores.
STRIP = 1024


def filter_arrays(h1: np.ndarray, value: np.ndarray, ok: np.ndarray, o: FitFCOptions) -> np.ndarray:
    """Mean over the most similar neighbours of (C, H, W) values, nearer ones weighing more, for the inner cells."""
    r, n = o.window // 2, o.neighbors
    bands = len(h1)
    height, width = ok.shape[0] - 2 * r, ok.shape[1] - 2 * r
    # offsets in order of distance, then row, then column: of equally similar neighbours the first ones stay
    cells = sorted((dy * dy + dx * dx, dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1))
    d2, off_y, off_x = (np.array(v) for v in zip(*cells, strict=True))
    weight = 1 / (1 + 2 * np.sqrt(d2) / o.window)
    n = min(n, len(cells))
    # small integers are exact in half the memory
    t = base_type(o.dtype)
    kind = np.float32 if t.integral and bands * (t.high - t.low) ** 2 < 1 << 24 and (np.where(ok, h1, 0) == np.rint(np.where(ok, h1, 0))).all() else np.float64
    near = np.where(ok, h1, np.nan).astype(kind)
    values = value.reshape(bands, -1)
    out = np.full((bands, height, width), np.nan)
    step = max(1, STRIP // width)
    for top in range(0, height, step):
        rows = min(step, height - top)
        center = near[:, r + top : r + top + rows, r : r + width]
        score = np.empty((len(cells), rows, width), kind)
        part = np.empty((rows, width), kind)
        for j in range(len(cells)):
            there = near[:, r + top + off_y[j] : r + top + off_y[j] + rows, r + off_x[j] : r + off_x[j] + width]
            np.subtract(there[0], center[0], out=score[j])
            np.square(score[j], out=score[j])
            for b in range(1, bands):
                np.subtract(there[b], center[b], out=part)
                np.square(part, out=part)
                score[j] += part
        score = score.reshape(len(cells), -1)
        score[np.isnan(score)] = np.inf
        last = np.partition(np.ascontiguousarray(score.T), n - 1, axis=1)[:, n - 1]
        # a missing neighbour is never taken, not even where there are fewer than n others
        j, cell = np.nonzero(score <= np.minimum(last, np.finfo(kind).max))
        order = np.lexsort((j, score[j, cell] == last[cell], cell))
        j, cell = j[order], cell[order]
        first = np.arange(len(cell)) - np.searchsorted(cell, cell) < n
        j, cell = j[first], cell[first]
        at = (r + top + cell // width + off_y[j]) * ok.shape[1] + r + cell % width + off_x[j]
        total = np.bincount(cell, weight[j], rows * width)
        for b in range(bands):
            with np.errstate(invalid="ignore", divide="ignore"):
                out[b, top : top + rows] = (np.bincount(cell, weight[j] * np.nan_to_num(values[b][at]), rows * width) / total).reshape(rows, width)
    return np.where(ok[r : r + height, r : r + width], out, np.nan)


SCHEMA = "pred_date int, y int, x int, value array<double>"


def predict(aligned: DataFrame, bands: int, height: int, width: int, options: FitFCOptions = FitFCOptions(), cut: bool = True) -> DataFrame:
    """Predict from rows pred_date, y, x, band with h1, l1, l2, ok of dense images."""
    mapped = regression(aligned, options)
    residual = smooth_residual(mapped, height, width, options.resolution_factor).withColumnRenamed("residual", "_r")
    both = mapped.join(residual, ["pred_date", "band", "y", "x"])
    cells = both.withColumn("_v", F.col("frm") + F.col("_r")).groupBy("pred_date", "y", "x").agg(by_band("h1").alias("h1"), by_band("_v").alias("v"), F.bool_and("ok").alias("ok"))
    r = options.window // 2
    write = F.lit(True)
    if options.area is not None:
        cells = cells.filter(options.area.grown(r).contains(F.col("x"), F.col("y")))
        write = options.area.contains(F.col("x"), F.col("y"))
    t = base_type(options.dtype)

    def kernel(tile: Tile) -> pd.DataFrame:
        out = filter_arrays(tile.bands("h1", bands), tile.bands("v", bands), tile.mask("ok"), options)
        if cut and t.integral:
            out = np.clip(np.rint(out), t.low, t.high)
        rows = tile.inner() & tile.pdf["_write"].to_numpy()
        values = out[:, tile.y[rows] - r, tile.x[rows] - r].T
        return pd.DataFrame({"pred_date": tile.pdf["pred_date"].to_numpy()[rows], "y": tile.pdf["y"].to_numpy()[rows], "x": tile.pdf["x"].to_numpy()[rows], "value": list(np.ascontiguousarray(values))})

    out = by_tile(cells.withColumn("_write", write), r, SCHEMA, kernel, ["pred_date"], options.tile)
    # a missing value leaves the kernel as NaN
    return out.withColumn("value", F.transform("value", lambda e: F.when(~F.isnan(e), e)))
