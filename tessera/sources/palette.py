"""Colour tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(cells: DataFrame, index: str, palette: DataFrame) -> DataFrame:
    """Replace palette indices by colours; an index outside the table is black.

    ``palette`` has a column index and one per channel: 256 rows at most.
    """
    channels = [c for c in palette.columns if c != "index"]
    table = F.broadcast(palette.withColumnRenamed("index", "_index"))
    out = cells.join(table, F.col(index) == F.col("_index"), "left").drop("_index")
    for c in channels:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out


def kind(palette: DataFrame) -> str:
    """'gray' if every entry has equal colours, else 'rgb'."""
    return "rgb" if palette.filter("r <> g or g <> b").limit(1).count() else "gray"
