"""Windows in space: separable sums, shifted cells and tiles with halos."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 128


def box_sum(dense: DataFrame, radius: int, columns: dict[str, Column], keys: list[str]) -> DataFrame:
    """Sums over (2 radius + 1)^2 windows, clipped at the edge: two passes of one dimension.

    Exact on dense rasters only: a cell without a row would take its column's part away.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    part = dense.select("*", *[F.sum(c).over(row).alias(f"_{n}") for n, c in columns.items()])
    return part.select(*dense.columns, *[F.sum(f"_{n}").over(column).alias(n) for n in columns])


def distance_weight(dx: Column, dy: Column, window: int) -> Column:
    """1 + 2 distance / window: how much less a farther neighbour counts."""
    return F.sqrt((dx * dx + dy * dy).cast("double")) * 2.0 / window + 1.0


def offsets(spark, radius: int) -> DataFrame:
    """dx, dy and dist of a window's cells."""
    side = 2 * radius + 1
    cells = spark.range(side * side).select(((F.col("id") % side) - radius).cast("int").alias("dx"), ((F.col("id") / side).cast("int") - radius).cast("int").alias("dy"))
    return cells.withColumn("weight", distance_weight(F.col("dx"), F.col("dy"), side))


def neighbours(cells: DataFrame, dx: int, dy: int, columns: list[str], keys: list[str]) -> DataFrame:
    """Values of the cell at (x + dx, y + dy), joined as n_<column>."""
    moved = cells.select(*keys, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return cells.join(moved, [*keys, "x", "y"], "left")


def tiles(cells: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Copy each cell to every tile whose padded extent holds it: adds ty, tx.

    Tiles around the image hold halo cells alone; they have nothing to write.
    """
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    return cells.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))


class Tile:
    """A padded tile as arrays; missing cells are NaN and not ok."""

    def __init__(self, pdf: pd.DataFrame, halo: int, tile: int):
        self.pdf, self.halo = pdf, halo
        self.y0, self.x0 = int(pdf["ty"].iloc[0]) * tile - halo, int(pdf["tx"].iloc[0]) * tile - halo
        self.side = tile + 2 * halo
        self.y, self.x = pdf["y"].to_numpy() - self.y0, pdf["x"].to_numpy() - self.x0

    def array(self, column: str, fill: float = np.nan) -> np.ndarray:
        out = np.full((self.side, self.side), fill)
        values = pd.to_numeric(self.pdf[column], errors="coerce").to_numpy(float)
        out[self.y, self.x] = np.where(np.isnan(values), fill, values)
        return out

    def bands(self, column: str, count: int) -> np.ndarray:
        """(bands, side, side) from an array column."""
        out = np.full((count, self.side, self.side), np.nan)
        column = self.pdf[column]
        if column.notna().all() and (flat := np.concatenate(column.to_numpy())).dtype.kind in "fib" and len(flat) == count * len(column):
            out[:, self.y, self.x] = flat.reshape(-1, count).T
            return out
        rows = np.array([np.full(count, np.nan) if v is None else np.array([np.nan if e is None else e for e in v], float) for v in column]).reshape(-1, count)
        out[:, self.y, self.x] = rows.T
        return out

    def mask(self, column: str) -> np.ndarray:
        out = np.zeros((self.side, self.side), bool)
        out[self.y, self.x] = self.pdf[column].fillna(False).astype(bool).to_numpy()
        return out

    def inner(self) -> np.ndarray:
        """Rows of the frame that lie in the tile itself."""
        h, n = self.halo, self.side - self.halo
        return (self.y >= h) & (self.y < n) & (self.x >= h) & (self.x < n)


def by_tile(cells: DataFrame, halo: int, schema: str, kernel: Callable[[Tile], pd.DataFrame], keys: list[str], tile: int = TILE) -> DataFrame:
    """Run a kernel on every padded tile of every image named by keys."""

    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tile(pdf, halo, tile)
        writes = t.inner() & (pdf["_write"].to_numpy() if "_write" in pdf else True)
        return kernel(t) if writes.any() else pd.DataFrame({n: [] for n in names}, dtype=object)

    return tiles(cells, halo, tile).groupBy(*keys, "ty", "tx").applyInPandas(run, schema)
