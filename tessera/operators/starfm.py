"""STARFM: prediction from one or two pairs by weighted similar neighbours."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.functions.geo import Rectangle
from tessera.model import base_type
from tessera.operators.neighborhood import TILE, Tile, by_tile


@dataclass(frozen=True)
class StarfmOptions:
    window: int = 51
    classes: float = 40
    log_scale: float = 0.0
    spectral_uncertainty: float | None = None
    temporal_uncertainty: float | None = None
    strict: bool = False
    copy_zero: bool = False
    temporal_weight: bool | None = None
    dtype: str = "uint8"
    area: Rectangle | None = None
    tile: int = TILE

    def __post_init__(self) -> None:
        if self.window < 1 or self.window % 2 == 0:
            raise InvalidArgument("the window must be odd")
        if self.classes <= 0 or self.log_scale < 0:
            raise InvalidArgument("classes must be positive and log_scale not negative")
        base_type(self.dtype)

    def sigma(self, which: str) -> float:
        given = self.spectral_uncertainty if which == "spectral" else self.temporal_uncertainty
        return given if given is not None else (1.0 if self.dtype in ("int8", "uint8") else 50.0)


def _saturate(a: np.ndarray, dtype: str) -> np.ndarray:
    t = base_type(dtype)
    return np.clip(np.rint(a), t.low, t.high) if t.integral else a


def _truncate(a: np.ndarray, dtype: str) -> np.ndarray:
    t = base_type(dtype)
    return np.clip(np.trunc(a), t.low, t.high) if t.integral else a


def predict_arrays(high: list[np.ndarray], low: list[np.ndarray], now: np.ndarray, ok: np.ndarray, tolerance: list[float], o: StarfmOptions, cut: bool = True) -> np.ndarray:
    """The inner cells of one band of a tile padded by half a window; cells that are not ok are NaN.

    A neighbour's weight is near / d + flat, d from the offset alone: both parts and their
    products with the neighbour's value are made once, and an offset only adds views of them.
    """
    double = len(high) == 2
    weigh_time = double if o.temporal_weight is None else o.temporal_weight
    s_t, s_s = o.sigma("temporal"), o.sigma("spectral")
    s_dt, s_ds = s_t * math.sqrt(2), math.sqrt(s_t**2 + s_s**2)
    s_c = math.sqrt(s_ds**2 + s_dt**2)
    r = o.window // 2
    height, width = now.shape[0] - 2 * r, now.shape[1] - 2 * r
    inner = (slice(r, r + height), slice(r, r + width))
    spectral = [np.abs(l_ - h) for h, l_ in zip(high, low, strict=True)]
    temporal = [np.abs(l_ - now) for l_ in low]
    local = [_saturate(h + now - l_, o.dtype) for h, l_ in zip(high, low, strict=True)]
    t_most = _saturate(np.minimum.reduce([t[inner] + s_dt for t in temporal]), o.dtype)
    s_most = _saturate(np.minimum.reduce([s[inner] + s_ds for s in spectral]), o.dtype)
    sides = []
    for k in range(len(high)):
        tw = temporal[k] if weigh_time else np.zeros_like(now)
        with np.errstate(invalid="ignore"):
            if o.log_scale > 0:
                near = 1 / (np.log(2 + tw * o.log_scale) * np.log(2 + spectral[k] * o.log_scale))
                flat = np.zeros_like(near)
            else:
                both = (1 + tw) * (1 + spectral[k])
                near, flat = np.where(both >= s_c, 1 / both, 0.0), (both < s_c).astype(float)
        near, flat, value = (np.where(ok, a, 0.0) for a in (near, flat, local[k]))
        # a cell that is not ok is like no other
        sides.append((np.where(ok, high[k], np.nan), temporal[k], spectral[k], near, near * value, flat if flat.any() else None, flat * value))
    weights, total = np.zeros((height, width)), np.zeros((height, width))
    difference, use, small, other = np.empty_like(total), np.empty(total.shape, bool), np.empty(total.shape, bool), np.empty(total.shape, bool)
    share = np.empty_like(total)
    join = np.logical_and if o.strict else np.logical_or
    with np.errstate(invalid="ignore"):
        for dy in range(2 * r + 1):
            for dx in range(2 * r + 1):
                at = (slice(dy, dy + height), slice(dx, dx + width))
                closer = 1 / (1 + 2 * math.hypot(dx - r, dy - r) / o.window)
                for k, (h, t, s, near, near_value, flat, flat_value) in enumerate(sides):
                    np.subtract(h[at], h[inner], out=difference)
                    np.abs(difference, out=difference)
                    np.less(difference, tolerance[k], out=use)
                    np.less(t[at], t_most, out=small)
                    np.less(s[at], s_most, out=other)
                    join(small, other, out=small)
                    np.logical_and(use, small, out=use)
                    np.multiply(use, closer, out=share)
                    weights += np.multiply(near[at], share, out=difference)
                    total += np.multiply(near_value[at], share, out=difference)
                    if flat is not None:
                        weights += np.multiply(flat[at], use, out=difference)
                        total += np.multiply(flat_value[at], use, out=difference)
    high, spectral, temporal, local, now, ok = ([v[inner] for v in a] if isinstance(a, list) else a[inner] for a in (high, spectral, temporal, local, now, ok))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(weights > 0, total / weights, np.mean(local, axis=0))
    if cut:
        out = _truncate(out, o.dtype)
    if o.copy_zero:
        for h, s in zip(high, spectral, strict=True):
            out = np.where(s == 0, now, out)
        for h, t in zip(high, temporal, strict=True):
            out = np.where(t == 0, h, out)
        if double:
            both = (temporal[0] == 0) & (temporal[1] == 0)
            mean = (high[0] + high[1]) / 2
            out = np.where(both, _truncate(mean, o.dtype) if cut else mean, out)
    return np.where(ok, out, np.nan)


SCHEMA = "pred_date int, y int, x int, band int, value double"


def predict(aligned: DataFrame, options: StarfmOptions = StarfmOptions(), double: bool = False, cut: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Predict low-only dates; ``only`` (y, x) names the cells to predict, or (pred_date, y, x) by date.

    ``aligned`` has one row per pred_date, y, x and band with h1, l1, l2 (h3, l3 for
    two pairs) and ok.  Tolerances are of whole images, whatever the prediction area;
    the area's halo is cut out before anything is shuffled.
    """
    names = ["h1", "h3"] if double else ["h1"]
    v = lambda n: F.when(F.col("ok"), F.col(n))
    spread = aligned.groupBy("pred_date", "band").agg(*[(F.stddev_pop(v(n)) * 2 / options.classes).alias(f"tol_{n}") for n in names])
    r = options.window // 2
    cells = aligned
    write = F.lit(True)
    if options.area is not None:
        cells = cells.filter(options.area.grown(r).contains(F.col("x"), F.col("y")))
        write = options.area.contains(F.col("x"), F.col("y"))
    if only is not None:
        cells = cells.join(only.withColumn("_only", F.lit(True)), [c for c in ("pred_date", "y", "x") if c in only.columns], "left")
        write = write & F.coalesce("_only", F.lit(False))
    cells = cells.withColumn("_write", write).join(F.broadcast(spread), ["pred_date", "band"])  # a row per image band

    def kernel(t: Tile) -> pd.DataFrame:
        ok = t.mask("ok")
        lows = ["l1", "l3"] if double else ["l1"]
        tolerance = [float(t.pdf[f"tol_{n}"].iloc[0]) if t.pdf[f"tol_{n}"].notna().iloc[0] else 0.0 for n in names]
        out = predict_arrays([t.array(n) for n in names], [t.array(n) for n in lows], t.array("l2"), ok, tolerance, options, cut)
        rows = t.inner() & t.pdf["_write"].to_numpy()
        values = out[t.y[rows] - r, t.x[rows] - r]
        return pd.DataFrame({"pred_date": t.pdf["pred_date"].to_numpy()[rows], "y": t.pdf["y"].to_numpy()[rows], "x": t.pdf["x"].to_numpy()[rows], "band": t.pdf["band"].to_numpy()[rows], "value": pd.arrays.FloatingArray(np.ascontiguousarray(values), np.isnan(values))})

    return by_tile(cells, r, SCHEMA, kernel, ["pred_date", "band"], options.tile)
