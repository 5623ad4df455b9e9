"""TIFF files, arguments as text, reference systems and files."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import FileFormatError, InvalidArgument, NotFound, NotImplementedFeature, SizeError
from tessera.functions import parsing, srs
from tessera.functions.geo import GeoTransform, Rectangle
from tessera.operators import warp
from tessera.sources import files, raster, tiff
from tessera.sources.info import GeoInfo


# --- TIFF ----------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"a", b"ab", b"\0" * 40]), max_size=300).map(b"".join)))
def test_lzw_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_over_full_tables():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert len(tiff.lzw_encode(bytes(50_000))) < 2000


def test_lzw_codes():
    """The example every description of the format gives: 7 7 7 8 8 7 7 6 6."""
    bits = "".join(f"{b:08b}" for b in tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))
    assert [int(bits[i : i + 9], 2) for i in range(0, 81, 9)] == [256, 7, 258, 8, 8, 258, 6, 6, 257]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(["uint8", "int8", "uint16", "int16", "int32", "float32", "float64"]), st.sampled_from([None, "lzw", "deflate"]), st.booleans(), st.sampled_from([None, 16, 32]), st.integers(1, 40), st.integers(1, 40), st.integers(1, 4))
def test_tiff_round_trip(dtype, compress, predictor, tile, height, width, bands):
    rng = np.random.default_rng(height * width)
    a = (rng.normal(size=(bands, height, width)) * 50).astype(dtype)
    predictor = predictor and a.dtype.kind != "f"
    back, told = tiff.decode(tiff.encode(a, None, compress, predictor, tile))
    assert (back == a).all() and back.dtype == a.dtype and (told.width, told.height, told.bands, told.base_type) == (width, height, bands, dtype)


def test_tiff_tells_what_it_knows():
    a = np.arange(12, dtype=np.uint8).reshape(1, 3, 4)
    info = GeoInfo(4, 3, 1, "uint8", (255.0,), GeoTransform(500000, 30, 0, 4000000, 0, -30), "EPSG:32633", ((1, 2, 3, 255), (9, 8, 7, 255)), {"": {"a": "x < y & z"}, "sub": {"k": "v"}})
    told = tiff.infos(tiff.encode(a, info))[0]
    assert (told.nodata, told.geotransform, told.srs, told.metadata) == (info.nodata, info.geotransform, info.srs, info.metadata)
    assert told.same_colors(info) and not told.same_colors(GeoInfo(4, 3, 1, "uint8"))
    ties = (("1", "", 0.0, 0.0, 10.0, 50.0, 0.0), ("2", "", 4.0, 0.0, 11.0, 50.0, 0.0))
    told = tiff.infos(tiff.encode(a, GeoInfo(4, 3, 1, "uint8", srs="EPSG:4326", gcps=ties)))[0]
    assert told.gcps == ties and told.srs == "EPSG:4326" and told.cropped(Rectangle(1, 0, 2, 2)).gcps[1][2] == 3.0


def test_tiff_pages_and_errors():
    a, b = np.ones((1, 2, 3), np.uint8), np.full((2, 2, 3), 7, np.int16)
    blob = tiff.joined([tiff.encode(a), tiff.encode(b, tile=16), tiff.encode(a + 1, compress=None)])
    assert [i.bands for i in tiff.infos(blob)] == [1, 2, 1]
    assert (tiff.decode(blob, 1)[0] == b).all() and (tiff.decode(blob, 2)[0] == 2).all()
    for wrong in (lambda: tiff.decode(blob, 3), lambda: tiff.decode(b"GIF89a"), lambda: tiff.encode(a, tile=20), lambda: tiff.encode(a.astype(float), predictor=True), lambda: tiff.lzw_decode(b"\xff\xff\xff"), lambda: raster.format_of_content(b"GIF8")):
        with pytest.raises(FileFormatError):
            wrong()
    assert raster.format_of_content(blob) == "GTiff" and raster.extensions_of("GTiff") == [".tif", ".tiff"]


def test_files_written_and_read(spark, tmp_path):
    """Images of many tiles, holes in them, pages as further bands, and a catalog of all."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 250, (2, 70, 50))
    rows = [("t", d, y, x, b, float(a[b, y, x] + d), True) for d in (1, 2) for b in range(2) for y in range(70) for x in range(50) if y < 60 or d == 1]
    pixels = spark.createDataFrame(rows, "tag string, date int, y int, x int, band int, value double, valid boolean").repartition(3)
    info = GeoInfo(50, 70, 2, "int16", (-1.0, -1.0), GeoTransform(5, 2, 0, 9, 0, -2), "EPSG:3857")
    paths = raster.write_tiffs(raster.to_tiffs(pixels, info, "deflate", True, 32), str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["t_1.tif", "t_2.tif"]
    names = [("t", 1, paths[0]), ("t", 2, paths[1]), ("again", 2, paths[1])]
    got = raster.read_tiff(spark, names)
    assert got.filter("tag = 't' and date = 2 and not valid").count() == 2 * 10 * 50 and got.filter("tag = 'again'").count() == 7000
    same = got.filter("valid and tag = 't'").select("date", "y", "x", "band", "value")
    assert same.exceptAll(pixels.select(*same.columns)).count() == 0 and same.count() == len(rows)
    told = {(r["tag"], r["date"]): raster.info_of(r) for r in raster.catalog(spark, names).collect()}
    assert len(told) == 3 and told["again", 2].geotransform == info.geotransform and told["t", 1].srs == "EPSG:3857"
    (tmp_path / "two.tif").write_bytes(tiff.joined([tiff.encode(a[:1].astype(np.uint8)), tiff.encode(a[1:].astype(np.uint8))]))
    both = raster.read_tiff(spark, [("p", 1, str(tmp_path / "two.tif"))], pages=[0, 1])
    assert {r["band"]: r["s"] for r in both.groupBy("band").agg(F.sum("value").alias("s")).collect()} == {0: a[0].sum(), 1: a[1].sum()}


def test_info_arithmetic():
    info = GeoInfo(10, 10, 1, "uint8", geotransform=GeoTransform(100, 2, 0, 200, 0, -2))
    other = GeoInfo(10, 10, 1, "uint8", geotransform=GeoTransform(108, 2, 0, 196, 0, -2))
    assert info.intersected(other) == Rectangle(4, 2, 6, 8)
    assert info.with_extents(Rectangle(0, 0, 20, 10)).geotransform == GeoTransform(0, 2, 0, 10, 0, -1)
    more = info.with_item("a", "1").with_item("b", "2", "d")
    assert more.item("b", "d") == "2" and more.without_items("d").metadata == {"": {"a": "1"}} and more.without_items("", "a").metadata == {"d": {"b": "2"}}
    with pytest.raises(NotFound):
        more.item("b")
    cut = info.of_prediction(Rectangle(2, 3, 4, 0), "x")
    assert (cut.width, cut.height, cut.geotransform.x0, cut.geotransform.y0) == (4, 7, 104, 194) and cut.item("SOURCE") == "x"
    with pytest.raises(SizeError):
        info.of_prediction(Rectangle(8, 0, 4, 4))


def test_names_options_and_statistics(spark, tmp_path):
    assert raster.fallback_names("/a/b.xyz") == ["/a/b.xyz", "/a/b.tif", "/a/save_b.tif"]
    (tmp_path / "o").write_text("--x=1 # no\n--name='two words' -y\n")
    assert raster.read_options(str(tmp_path / "o")) == ["--x=1", "--name=two words", "-y"]
    table = raster.statistics_text(spark.createDataFrame([("a", 10, 5), ("bb", 2, 12345)], "tag string, date int, n long"))
    assert table.splitlines() == ["tag  date      n", "  a    10      5", " bb     2  12345"]


def test_collection_checks(spark):
    rows = [(t, d, 0, 0, 0, 1.0, True) for t, d in (("a", 1), ("a", 2), ("b", 2))]
    c = raster.Collection(spark.createDataFrame(rows, "tag string, date int, y int, x int, band int, value double, valid boolean"))
    c.check_tags(2)
    c.check_images({"a": 2, "b": 1})
    assert c.select([2]).keys() == [("a", 2), ("b", 2)] and c.clone().remove("a").keys() == [("b", 2)] and c.has("a")
    for wrong in (lambda: c.check_tags(3), lambda: c.check_images({"b": 2})):
        with pytest.raises(InvalidArgument):
            wrong()
    with pytest.raises(NotFound):
        c.select([1, 3])


def test_files(spark, tmp_path):
    f, at = files.Files(spark), str(tmp_path / "d")
    assert not f.exists(at) and f.make(at + "/e") and f.is_directory(at) and not f.is_file(at)
    (tmp_path / "d" / "e" / "x.bin").write_bytes(b"123")
    (found,) = f.list(at, recursive=True)
    assert f.size(found) == 3 and f.is_file(found) and f.list(at) == [] and files.stem(found) == "x" and files.extension(found) == ".bin"
    assert files.parent("/a/b/") == "/a" and files.join("/a", "b") == "/a/b" and files.is_absolute("s3://x") and files.is_absolute(files.absolute("y"))
    assert f.remove(at, recursive=True) and not f.exists(at) and files.temporary()


# --- arguments -----------------------------------------------------------------------------------
def test_angles_and_places():
    for text, want in (("12.5", 12.5), ("-3 30'", -3.5), ("48° 12' 9\" N", 48.2025), ("W 16d 30m", -16.5), ("10 30 36", 10.51), ("7' ", 7 / 60), ("5deg 6sec", 5 + 6 / 3600), ("-0 30'", -0.5)):
        assert parsing.angle(text) == pytest.approx(want), text
    for text in ("", "x", "10' 5d", "3 -4'", "5 61'", "N"):
        with pytest.raises(InvalidArgument):
            parsing.angle(text)
    for text, want in (("48.2, 16.4", (48.2, 16.4)), ("16° 24' E, 48° 12' N", (48.2, 16.4)), ("(10 20)", (10, 20)), ("5 S 7 W", (-5, -7))):
        assert parsing.geo_coordinate(text) == pytest.approx(want), text
    for text in ("91, 0", "1", "3 E, 4 E"):
        with pytest.raises(InvalidArgument):
            parsing.geo_coordinate(text)


def test_rectangles_sizes_and_words():
    for text, want in (("-x=1 -y=2 -w=3 -h=4", (1, 2, 3, 4)), ("-x=(1,3) -y=(2, 5)", (1, 2, 3, 4)), ("(1, 2, 3, 4)", (1, 2, 3, 4)), ("-center=(10 20) -w=4 -h=6", (8, 17, 4, 6)), ("-x=1 -y=1", (1, 1, 0, 0))):
        assert parsing.rectangle(text) == Rectangle(*want), text
    assert parsing.rectangle("-x=(0.5,1.5) -y=0 -h=2", whole=False) == Rectangle(0.5, 0, 1.0, 2)
    for text in ("-x=1", "-x=1 -y=2 -w=-3 -h=1", "-x=(1,3) -w=2 -y=0", "-x=1 -x=2 -y=0", "what", "-center=(1,1) -w=3", "(1, 2, 3.5, 4)"):
        with pytest.raises(InvalidArgument):
            parsing.rectangle(text)
    assert parsing.size("30x20") == parsing.size("(30, 20)") == (30, 20) and parsing.coordinate("1.5 -2") == (1.5, -2)
    assert parsing.words("a (b (c d)) 'e f' g=\"h i\"") == ["a", "(b (c d))", "e f", "g=h i"]
    assert parsing.integer(" 7 ") == 7 and parsing.number("1e3") == 1000 and parsing.base_type("Float32") == "float32"
    for wrong in (lambda: parsing.words("(a"), lambda: parsing.words("a)"), lambda: parsing.words("'a"), lambda: parsing.integer("1.5"), lambda: parsing.number("x"), lambda: parsing.base_type("int64"), lambda: parsing.point("1.5 2"), lambda: parsing.size("-1x2")):
        with pytest.raises(InvalidArgument):
            wrong()


def test_image_arguments():
    got = parsing.ImageArgument.parse("-f='my image.tif' -d=20190523 -t=high -b=(0, 2) -c=(1,2,3,4) --disable-use-color-table")
    assert got == parsing.ImageArgument("my image.tif", 20190523, "high", (0, 2), Rectangle(1, 2, 3, 4), False) and got.named() is got
    assert parsing.ImageArgument.parse("x.tif -d 3 -c (-x=1 -y=2 -w=3 -h=4)") == parsing.ImageArgument("x.tif", 3, crop=Rectangle(1, 2, 3, 4))
    for wrong in ("-d=3", "x.tif y.tif", "x.tif -d=1 -d=2", "x.tif -d=a", "x.tif -d"):
        with pytest.raises(InvalidArgument):
            parsing.ImageArgument.parse(wrong)
    with pytest.raises(InvalidArgument):
        parsing.ImageArgument("x.tif", 3).named()


# --- reference systems and warping ---------------------------------------------------------------
def test_reference_systems(spark):
    """Known places, and there and back."""
    rows = [(16.3738, 48.2082), (-0.1276, 51.5072), (15.0, 0.0), (151.2093, -33.8688)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    mx, my = srs.mappings("EPSG:3857")[1](lon, lat)
    first = df.select(mx.alias("x"), my.alias("y")).first()
    assert first["x"] == pytest.approx(math.radians(16.3738) * 6378137) and first["y"] == pytest.approx(6378137 * math.log(math.tan(math.pi / 4 + math.radians(48.2082) / 2)))
    ux, uy = srs.mappings("EPSG:32633")[1](lon, lat)
    at = df.filter("lon = 15").select(ux.alias("x"), uy.alias("y")).first()
    assert at["x"] == pytest.approx(500000, abs=1e-6) and at["y"] == pytest.approx(0, abs=1e-6)
    # the meridian arc from the equator to 45 degrees is 4984944.378 m
    north = df.limit(1).select(srs.mappings("EPSG:32633")[1](F.lit(15.0), F.lit(45.0))[1].alias("y")).first()["y"]
    assert north / 0.9996 == pytest.approx(4984944.378, abs=0.01)
    for name, where in (("EPSG:3857", "true"), ("EPSG:32633", "lon between 12 and 18"), ("EPSG:32756", "lon > 150")):
        to, back = srs.mappings(name)
        a, b = to(*back(lon, lat))
        for r in df.filter(where).select("lon", "lat", a.alias("a"), b.alias("b")).collect():
            assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-8)
    t = GeoTransform(500000, 10, 0, 5400000, 0, -10)
    x, y = srs.image_to_image(F.lit(3.0), F.lit(4.0), t, "EPSG:32633", t, "EPSG:32633")
    assert tuple(df.limit(1).select(x, y).first()) == pytest.approx((3, 4))
    with pytest.raises(NotImplementedFeature):
        srs.mappings("EPSG:31287")
    srs.register("LOCAL:1", lambda p, q: (p / 2, q / 2), lambda p, q: (p * 2, q * 2))
    assert tuple(df.limit(1).select(*srs.projection_to_projection(F.lit(4.0), F.lit(6.0), "LOCAL:1", "EPSG:4326")).first()) == (2.0, 3.0)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "cubic_spline"])
def test_warp_keeps_planes(spark, method):
    """A plane stays a plane under every kernel that reproduces it, a constant under all; a hole is bridged."""
    rows = [("a", 1, y, x, b, (3.0 * x + 2.0 * y + 1.0) if b == 0 else 7.0, not (b == 1 and (y, x) == (6, 6))) for b in range(2) for y in range(16) for x in range(16)]
    pixels = spark.createDataFrame(rows, "tag string, date int, y int, x int, band int, value double, valid boolean")
    out = warp.warp(pixels, GeoTransform(), GeoTransform(4.0, 0.5, 0.0, 4.0, 0.0, 0.5), 12, 12, method)
    for r in out.collect():
        if r["band"] == 1:
            assert r["value"] is None or r["value"] == pytest.approx(7.0)
        elif method != "nearest":
            assert r["value"] == pytest.approx(3 * (4 + (r["x"] + 0.5) / 2 - 0.5) + 2 * (4 + (r["y"] + 0.5) / 2 - 0.5) + 1)


def test_warp_between_systems(spark):
    """Each target cell takes the source cell that its place on earth lies in."""
    rows = [("a", 1, y, x, 0, float(y * 40 + x), True) for y in range(40) for x in range(40)]
    pixels = spark.createDataFrame(rows, "tag string, date int, y int, x int, band int, value double, valid boolean")
    source = GeoTransform(14.9, 0.01, 0.0, 48.2, 0.0, -0.01)
    target = GeoTransform(500000.0, 1000.0, 0.0, 5330000.0, 0.0, -1000.0)
    got = warp.warp(pixels, source, target, 10, 10, "nearest", "EPSG:4326", "EPSG:32633").collect()
    to = srs.mappings("EPSG:32633")[0]
    cells = spark.range(100).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"))
    px, py = target.image_to_projection(F.col("x") + 0.5, F.col("y") + 0.5)
    lon, lat = to(px, py)
    want = {(r["y"], r["x"]): (r["lon"], r["lat"]) for r in cells.select("y", "x", lon.alias("lon"), lat.alias("lat")).collect()}
    assert len(got) > 50
    for r in got:
        lon, lat = want[r["y"], r["x"]]
        assert r["value"] == int((48.2 - lat) / 0.01) * 40 + int((lon - 14.9) / 0.01)
