"""ESTARFM: prediction between two pairs with conversion factors from regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.functions.geo import Rectangle
from tessera.model import base_type
from tessera.operators.neighborhood import TILE, Tile, by_tile


@dataclass(frozen=True)
class EstarfmOptions:
    window: int = 51
    classes: float = 4.0
    uncertainty: float = 0.002
    local_tolerance: bool = False
    quality_weighted: bool = False
    data_range: tuple[float, float] | None = (0.0, 255.0)
    dtype: str = "uint8"
    area: Rectangle | None = None
    tile: int = TILE

    def __post_init__(self) -> None:
        if self.window < 1 or self.window % 2 == 0:
            raise InvalidArgument("the window must be odd")
        if self.classes <= 0:
            raise InvalidArgument("classes must be positive")
        base_type(self.dtype)


def incomplete_beta(a: float, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    b, x = np.broadcast_arrays(np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for up in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + up * d
            c = 1 + up / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-12):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def f_cdf(f: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distribution function of F(1, m)."""
    return incomplete_beta(0.5, np.asarray(m) / 2, f / (f + m))


def slope(n, sx, sy, sxx, sxy, syy, smooth: bool) -> np.ndarray:
    """Trusted regression slope of high on low from sums; 1 where it can't be trusted."""
    n, sx, sy, sxx, sxy, syy = (np.asarray(v, float) for v in (n, sx, sy, sxx, sxy, syy))
    det = n * sxx - sx * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        b = (n * sxy - sx * sy) / det
        r2 = (n * sxy - sx * sy) ** 2 / (det * (n * syy - sy * sy))
        f = (n - 2) / (1 / r2 - 1)
        usable = np.isfinite(f) & (f >= 0) & (n > 2)
        p = np.where(usable, f_cdf(np.where(usable, f, 1.0), np.where(usable, n - 2, 1.0)), 1.0)
    tested = b * p + (1 - p) if smooth else np.where(p < 0.95, 1.0, b)
    out = np.where(usable, tested, b)
    return np.where((np.abs(det) < 1e-14) | ~np.isfinite(b) | (b < 0) | (b > 5), 1.0, out)


def local_weight(low: list[np.ndarray], high: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Correlation of low and high over both pairs and all bands; masked bands count as 0, constants as 1."""
    x = np.concatenate([np.where(ok, v, 0.0) for v in low])
    y = np.concatenate([np.where(ok, v, 0.0) for v in high])
    x, y = x - x.mean(0), y - y.mean(0)
    vx, vy = (x * x).mean(0), (y * y).mean(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (x * y).mean(0) / np.sqrt(vx * vy)
    return np.where((vx < 1e-20) | (vy < 1e-20), 1.0, r)


def _window_sum(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad), axis=axis)
        n = a.shape[axis]
        a = np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)
    return a


def predict_arrays(h1, h3, l1, l3, l2, ok, tolerance: tuple[np.ndarray, np.ndarray], o: EstarfmOptions, cut: bool = True) -> np.ndarray:
    """The inner cells of all bands (C, H, W) of a tile padded by half a window; cells not ok are NaN."""
    r = o.window // 2
    zero = lambda a: np.where(ok, a, 0.0)
    lw = local_weight([l1, l3], [h1, h3], ok)
    if o.local_tolerance:
        n = _window_sum(ok.astype(float), r)
        with np.errstate(divide="ignore", invalid="ignore"):
            tol = [np.sqrt(np.maximum(_window_sum(zero(h) ** 2, r) / n - (_window_sum(zero(h), r) / n) ** 2, 0)) * 2 / o.classes for h in (h1, h3)]
    else:
        tol = [np.broadcast_to(t[:, None, None], h1.shape) for t in tolerance]
    height, width = h1.shape[1] - 2 * r, h1.shape[2] - 2 * r
    inner = (..., slice(r, r + height), slice(r, r + width))
    sum1, sum2, sum3 = (_window_sum(zero(v), r)[inner] for v in (l1, l2, l3))
    c = len(h1)
    every = ok.all(0)
    z1, z2, z3, y1, y3 = (np.where(every, v, 0.0) for v in (l1, l2, l3, h1, h3))
    weighed = np.concatenate([z2 - z1, z2 - z3, y1, y3])
    plain = np.concatenate([z1 + z3, y1 + y3, z1 * z1 + z3 * z3, z1 * y1 + z3 * y3, y1 * y1 + y3 * y3])
    # a cell that is not ok in all bands is like no other
    near = np.where(every, np.concatenate([h1, h3]), np.nan)
    limit = np.concatenate(tol)[inner]
    apart = 1 - np.where(every, lw, 0.0)
    count, sw = np.zeros((height, width)), np.zeros((height, width))
    sums, moments = np.zeros((4 * c, height, width)), np.zeros((5 * c, height, width))
    difference, buffer = np.empty(limit.shape), np.empty(moments.shape)
    with np.errstate(invalid="ignore"):
        for dy in range(2 * r + 1):
            for dx in range(2 * r + 1):
                at = (..., slice(dy, dy + height), slice(dx, dx + width))
                np.subtract(near[at], near[inner], out=difference)
                np.abs(difference, out=difference)
                use = (difference <= limit).all(0)
                if not use.any():
                    continue
                mask = use.astype(float)
                weight = mask / (apart[at] * (1 + 2 * math.hypot(dx - r, dy - r) / o.window) + 1e-7)
                count += mask
                sw += weight
                sums += np.multiply(weighed[at], weight, out=buffer[: 4 * c])
                moments += np.multiply(plain[at], mask, out=buffer)
    acc = {k: sums[i * c : (i + 1) * c] for i, k in enumerate(("d1", "d3", "h1", "h3"))} | {k: moments[i * c : (i + 1) * c] for i, k in enumerate(("x", "y", "xx", "xy", "yy"))}
    h1, h3, every = h1[inner], h3[inner], every[inner]
    t1, t3 = 1 / (np.abs(sum1 - sum2) + 1e-10), 1 / (np.abs(sum3 - sum2) + 1e-10)
    t1, t3 = t1 / (t1 + t3), t3 / (t1 + t3)
    n = 2 * count
    with np.errstate(divide="ignore", invalid="ignore"):
        fitted = slope(np.broadcast_to(n, h1.shape), acc["x"], acc["y"], acc["xx"], acc["xy"], acc["yy"], o.quality_weighted)
        deviation = np.sqrt(np.maximum((acc["xx"] - acc["x"] ** 2 / n) / (n - 1), 0))
        limit = -1.0 if o.data_range is None else o.data_range[1] * o.uncertainty * math.sqrt(2)
        reg = np.where(deviation > limit, fitted, 1.0)
        out = t1 * (h1 + reg * acc["d1"] / sw) + t3 * (h3 + reg * acc["d3"] / sw)
        if o.data_range is not None:
            mean = t1 * acc["h1"] / sw + t3 * acc["h3"] / sw
            out = np.where((out < o.data_range[0]) | (out > o.data_range[1]), mean, out)
    out = np.where(count <= 5, t1 * h1 + t3 * h3, out)
    t = base_type(o.dtype)
    if cut and t.integral:
        out = np.clip(np.trunc(out), t.low, t.high)
    return np.where(every, out, np.nan)


def by_band(column: str) -> Column:
    """Aggregate: values in the order of their bands."""
    return F.transform(F.array_sort(F.collect_list(F.struct("band", F.col(column).alias("v")))), lambda e: e["v"])


SCHEMA = "pred_date int, y int, x int, value array<double>"


def predict(aligned: DataFrame, bands: int, options: EstarfmOptions = EstarfmOptions(), cut: bool = True) -> DataFrame:
    """One row per pred_date, y, x with arrays over bands h1, h3, l1, l3, l2 and ok (boolean array)."""
    each = aligned.select("pred_date", F.posexplode(F.arrays_zip("h1", "h3", "ok")).alias("band", "v"))
    spread = each.groupBy("pred_date", "band").agg(*[(F.stddev_pop(F.when(F.col("v.ok"), F.col(f"v.{n}"))) * 2 / options.classes).alias(n) for n in ("h1", "h3")])
    spread = spread.groupBy("pred_date").agg(*[by_band(n).alias(f"tol_{n}") for n in ("h1", "h3")])
    r = options.window // 2
    cells, write = aligned, F.lit(True)
    if options.area is not None:
        cells = cells.filter(options.area.grown(r).contains(F.col("x"), F.col("y")))
        write = options.area.contains(F.col("x"), F.col("y"))
    cells = cells.withColumn("_write", write).join(F.broadcast(spread), "pred_date")  # a row per predicted image

    def kernel(t: Tile) -> pd.DataFrame:
        ok = t.bands("ok", bands) == 1
        tol = tuple(np.nan_to_num(np.array([np.nan if v is None else v for v in t.pdf[f"tol_{n}"].iloc[0]], float)) for n in ("h1", "h3"))
        out = predict_arrays(*(t.bands(n, bands) for n in ("h1", "h3", "l1", "l3", "l2")), ok, tol, options, cut)
        rows = t.inner() & t.pdf["_write"].to_numpy()
        values = out[:, t.y[rows] - r, t.x[rows] - r].T
        return pd.DataFrame({"pred_date": t.pdf["pred_date"].to_numpy()[rows], "y": t.pdf["y"].to_numpy()[rows], "x": t.pdf["x"].to_numpy()[rows], "value": list(np.ascontiguousarray(values))})

    out = by_tile(cells, r, SCHEMA, kernel, ["pred_date"], options.tile)
    # a missing value leaves the kernel as NaN
    return out.withColumn("value", F.transform("value", lambda e: F.when(~F.isnan(e), e)))
