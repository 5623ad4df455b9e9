"""Rasters on disk: a catalog of images, Parquet as the store, GeoTIFF at the edges.

GeoTIFF files are decoded on the executors, a whole file by one task; a crop or a
choice of bands is cut out there, before a row is made.  They are written by tiles: a
task codes one tile, and the task that puts a file together holds it coded only.
Parquet is the store for large images: it is partitioned by tag and date, so a crop, a
choice of bands or of dates prunes what is read.
"""

from __future__ import annotations

import math
import os
import shlex
import tempfile
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import FileFormatError, InvalidArgument, NotFound, SizeError
from tessera.functions.geo import Rectangle
from tessera.model import PIXELS
from tessera.sources import tiff
from tessera.sources.info import GeoInfo

#: Format by extension, their long names, and how a file of each begins.
FORMATS = {".tif": "GTiff", ".tiff": "GTiff", ".parquet": "Parquet", ".csv": "CSV"}
LONG_NAMES = {"GTiff": "GeoTIFF", "Parquet": "Apache Parquet", "CSV": "Comma separated values"}
_MAGIC = {b"II*\0": "GTiff", b"MM\0*": "GTiff", b"PAR1": "Parquet"}
CODED_TILE = 256


def format_of(path: str) -> str:
    """The format of a path by its extension."""
    ext = os.path.splitext(path)[1].lower()
    if ext not in FORMATS:
        raise FileFormatError(f"no format for {ext!r}")
    return FORMATS[ext]


def format_of_content(head: bytes) -> str:
    """The format of a file by how it begins."""
    if head[:4] not in _MAGIC:
        raise FileFormatError("the file's beginning names no format")
    return _MAGIC[head[:4]]


def extensions_of(name: str) -> list[str]:
    return [e for e, f in FORMATS.items() if f == name]


INFO = (
    "width int, height int, bands int, base_type string, nodata array<double>, geotransform array<double>, srs string, color_table array<struct<r:int,g:int,b:int,a:int>>, "
    "gcps array<struct<id:string,info:string,pixel:double,line:double,x:double,y:double,z:double>>, metadata map<string,map<string,string>>"
)


def _described(i: GeoInfo) -> dict:
    g = i.geotransform
    return {
        "width": i.width, "height": i.height, "bands": i.bands, "base_type": i.base_type, "nodata": list(i.nodata), "geotransform": [g.x0, g.dx, g.rx, g.y0, g.ry, g.dy], "srs": i.srs,
        "color_table": [dict(zip("rgba", c, strict=True)) for c in i.color_table], "gcps": [dict(zip(("id", "info", "pixel", "line", "x", "y", "z"), c, strict=True)) for c in i.gcps], "metadata": i.metadata,
    }


def _local(path: str) -> str:
    """A path as Spark reports it, without its scheme."""
    return path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path


def catalog(spark: SparkSession, images: list[tuple[str, int, str]]) -> DataFrame:
    """tag, date, path, page and what each page of the named GeoTIFFs says of itself, its header read by an executor."""
    names = spark.createDataFrame([(t, d, _local(p)) for t, d, p in images], "tag string, date int, path string")
    files = spark.read.format("binaryFile").load(sorted({p for *_, p in images}))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": _local(p), "page": n, **_described(i)} for p, b in zip(pdf["path"], pdf["content"], strict=True) for n, i in enumerate(tiff.infos(b))]
            yield pd.DataFrame(rows)

    return names.join(files.select("path", "content").mapInPandas(read, f"path string, page int, {INFO}"), "path").select("tag", "date", "path", "page", *[c.split()[0] for c in ("width", "height", "bands", "base_type", "nodata", "geotransform", "srs", "color_table", "gcps", "metadata")])


def info_of(row) -> GeoInfo:
    """A catalog row as GeoInfo."""
    from tessera.functions.geo import GeoTransform

    return GeoInfo(row["width"], row["height"], row["bands"], row["base_type"], tuple(row["nodata"]), GeoTransform(*row["geotransform"]), row["srs"], tuple(tuple(c) for c in row["color_table"]), {d: dict(m) for d, m in row["metadata"].items()}, tuple(tuple(c) for c in row["gcps"]))


def check_alike(images: DataFrame) -> None:
    """All images of a job have one resolution and one extent."""
    row = images.agg(*[F.countDistinct(c).alias(c) for c in ("width", "height", "geotransform")]).first()
    if row["width"] > 1 or row["height"] > 1:
        raise SizeError("images of different sizes")
    if row["geotransform"] > 1:
        raise InvalidArgument("images of different extents")


def read_tiff(spark: SparkSession, images: list[tuple[str, int, str]], bands: list[int] | None = None, crop: Rectangle | None = None, flip_x: bool = False, flip_y: bool = False, pages: list[int] | None = None) -> DataFrame:
    """Pixels of GeoTIFF files, decoded where the files are read.

    ``pages`` names subdatasets whose bands follow one another; the first page alone, if None.
    """
    wanted: dict[str, list[tuple[str, int]]] = {}
    for t, d, p in images:
        wanted.setdefault(_local(p), []).append((t, d))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"], strict=True):
                parts = [tiff.decode(blob, n) for n in (pages or [0])]
                info = parts[0][1]
                if len({(i.width, i.height) for _, i in parts}) > 1:
                    raise SizeError("pages of different sizes")
                nodata = [i.nodata[b] if i.nodata else math.nan for _, i in parts for b in range(i.bands)]
                pixels = np.concatenate([p for p, _ in parts])
                info = replace(info, bands=len(pixels), nodata=tuple(nodata))
                own = list(range(info.bands)) if bands is None else bands
                info.with_bands(own)
                area = crop or Rectangle(0, 0, info.width, info.height)
                part = info.cropped(area)
                x, y = int(area.x), int(area.y)
                yy, xx = (c.ravel() for c in np.mgrid[: part.height, : part.width].astype(np.int32))
                for tag, date in wanted[_local(path)]:
                    for band in own:
                        cell = pixels[band, y : y + part.height, x : x + part.width].astype(float)[:: -1 if flip_y else 1, :: -1 if flip_x else 1].ravel()
                        valid = np.ones(cell.size, bool) if math.isnan(info.nodata[band]) else cell != info.nodata[band]
                        yield pd.DataFrame({"tag": tag, "date": np.int32(date), "y": yy, "x": xx, "band": np.int32(band), "value": cell, "valid": valid})

    files = spark.read.format("binaryFile").load(sorted({p for *_, p in images})).select("path", "content")
    return files.mapInPandas(read, PIXELS)


def write_pixels(pixels: DataFrame, path: str, mode: str = "error") -> None:
    """The store: Parquet partitioned by tag and date, ordered for pruning by rows."""
    pixels.sortWithinPartitions("tag", "date", "y", "x").write.mode(mode).partitionBy("tag", "date").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIXELS).parquet(path)


def to_tiffs(pixels: DataFrame, info: GeoInfo, compress: str | None = "lzw", predictor: bool = False, tile: int = CODED_TILE) -> DataFrame:
    """tag, date and content: one tiled GeoTIFF per image; cells without a valid value get nodata (or 0).

    A task codes one tile of one image; the one that puts a file together holds it coded.
    """
    fill = 0.0 if not info.nodata or math.isnan(info.nodata[0]) else info.nodata[0]
    scheme, across = tiff.SCHEMES[compress], -(-info.width // tile)
    every = -(-info.height // tile) * across
    dtype = np.dtype(info.base_type)
    if predictor and dtype.kind == "f":
        raise FileFormatError("floats are not predicted")

    def code(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((tile, tile, info.bands), fill)
        out[pdf["y"] % tile, pdf["x"] % tile, pdf["band"]] = pdf["value"].where(pdf["valid"]).fillna(fill)
        return pd.DataFrame({"tag": [key[0]], "date": [key[1]], "place": [key[2]], "block": [tiff.pack(out.astype(dtype), scheme, predictor)]})

    place = (F.floor(F.col("y") / tile) * across + F.floor(F.col("x") / tile)).cast("int").alias("place")
    cells = pixels.select("tag", "date", place, "y", "x", "band", "value", "valid")
    coded = cells.groupBy("tag", "date", "place").applyInPandas(code, "tag string, date int, place int, block binary")
    empty = tiff.pack(np.full((tile, tile, info.bands), fill).astype(dtype), scheme, predictor)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = dict(zip(pdf["place"], pdf["block"], strict=True))
        content = tiff.assemble([blocks.get(i, empty) for i in range(every)], info, scheme, predictor, tile)
        return pd.DataFrame({"tag": [key[0]], "date": [key[1]], "content": [content]})

    return coded.groupBy("tag", "date").applyInPandas(whole, "tag string, date int, content binary")


def write_tiffs(files: DataFrame, folder: str, name: str = "{tag}_{date}.tif") -> list[str]:
    """Write the contents of to_tiffs as files; ``folder`` is one that all executors mount.

    A file appears under its name only when it is complete, so a task that runs twice does no harm.
    """
    target = _local(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for tag, date, content in zip(pdf["tag"], pdf["date"], pdf["content"], strict=True):
                path = os.path.join(target, name.format(tag=tag, date=date))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
                    f.write(content)
                os.replace(f.name, path)
                made.append(path)
            yield pd.DataFrame({"path": made})

    return sorted(r["path"] for r in files.mapInPandas(write, "path string").collect())  # a row per image


def output_name(prefix: str, date2: int, date1: int, date3: int | None = None, postfix: str = "", ext: str = "tif", stem: str = "predicted") -> str:
    """<prefix><date2>_from_<date1>[_and_<date3>]<postfix>.<ext>; the stem if all dates are equal."""
    if not prefix and not postfix:
        prefix = "predicted_"
    if date2 == date1 and date3 in (None, date1):
        return f"{prefix}{stem}{postfix}.{ext}"
    return f"{prefix}{date2}_from_{date1}{'' if date3 is None else f'_and_{date3}'}{postfix}.{ext}"


def fallback_names(path: str) -> list[str]:
    """Where an output goes: its own path, then the same as GeoTIFF, then under another name."""
    folder, name = os.path.split(path)
    stem = os.path.splitext(name)[0]
    return list(dict.fromkeys([path, os.path.join(folder, f"{stem}.tif"), os.path.join(folder, f"save_{stem}.tif")]))


def write_statistics(stats: DataFrame, path: str) -> None:
    """Interpolation counts as a table separated by semicolons."""
    stats.coalesce(1).write.option("sep", ";").option("header", True).mode("overwrite").csv(path)  # a row per image


def statistics_text(stats: DataFrame) -> str:
    """The same counts as an aligned table for the console; a row per image."""
    rows = [stats.columns, *[[str(v) for v in r] for r in stats.orderBy(*[c for c in ("tag", "date") if c in stats.columns]).collect()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(stats.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in rows)


def read_options(path: str) -> list[str]:
    """Arguments from an option file; # begins a comment, quotes keep blanks together."""
    with open(path, encoding="utf-8") as f:
        return shlex.split(f.read(), comments=True)


class Collection:
    """Images by (tag, date) over a pixels table."""

    def __init__(self, pixels: DataFrame):
        self.pixels = pixels
        self._keys: list[tuple[str, int]] | None = None

    def keys(self) -> list[tuple[str, int]]:
        """Sorted; one entry per image."""
        if self._keys is None:
            self._keys = [tuple(r) for r in self.pixels.select("tag", "date").distinct().orderBy("tag", "date").collect()]
        return self._keys

    def has(self, tag: str | None = None, date: int | None = None) -> bool:
        return any((tag is None or t == tag) and (date is None or d == date) for t, d in self.keys())

    def get(self, tag: str, date: int) -> DataFrame:
        if not self.has(tag, date):
            raise NotFound(f"no image {tag!r} of {date}")
        return self.pixels.filter((F.col("tag") == tag) & (F.col("date") == date))

    def get_any(self, tag: str | None = None, date: int | None = None) -> DataFrame:
        """The first in the order of tags and dates."""
        for t, d in self.keys():
            if (tag is None or t == tag) and (date is None or d == date):
                return self.get(t, d)
        raise NotFound("no such image")

    def put(self, pixels: DataFrame) -> Collection:
        """Images of pixels replace those of the same tag and date."""
        new = pixels.select("tag", "date").distinct()
        return Collection(self.pixels.join(F.broadcast(new), ["tag", "date"], "left_anti").unionByName(pixels))

    def remove(self, tag: str | None = None, date: int | None = None) -> Collection:
        if not self.has(tag, date):
            raise NotFound("no such image")
        hit = (F.lit(True) if tag is None else F.col("tag") == tag) & (F.lit(True) if date is None else F.col("date") == date)
        return Collection(self.pixels.filter(~hit))

    def tags(self, date: int | None = None) -> list[str]:
        return sorted({t for t, d in self.keys() if date is None or d == date})

    def dates(self, tag: str | None = None) -> list[int]:
        return sorted({d for t, d in self.keys() if tag is None or t == tag})

    def clone(self) -> Collection:
        """Another collection of the same images; what is put into one doesn't show in the other."""
        return Collection(self.pixels)

    def select(self, dates: list[int], tag: str | None = None) -> Collection:
        """Images of the given dates; all of them have to be there."""
        missing = sorted(set(dates) - set(self.dates(tag)))
        if missing:
            raise NotFound(f"no image of {missing}")
        return Collection(self.pixels.filter(F.col("date").isin(sorted(set(dates))) & (F.lit(True) if tag is None else F.col("tag") == tag)))

    def check_tags(self, number: int = 2) -> None:
        """As many resolution tags as a job needs."""
        if len(self.tags()) != number:
            raise InvalidArgument(f"{number} tags are needed, there are {self.tags()}")

    def check_images(self, least: dict[str, int]) -> None:
        """At least so many images of each tag."""
        for tag, n in least.items():
            if self.count(tag) < n:
                raise InvalidArgument(f"{n} images of {tag!r} are needed, there are {self.count(tag)}")

    def count(self, tag: str | None = None, date: int | None = None) -> int:
        return sum((tag is None or t == tag) and (date is None or d == date) for t, d in self.keys())
