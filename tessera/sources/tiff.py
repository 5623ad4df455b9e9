"""TIFF files as bytes: strips and tiles, LZW and deflate, horizontal prediction, GeoTIFF keys, pages.

A file may hold several pages, its subdatasets.  Every block is coded by itself, so
blocks of one image can be made by different tasks and put together afterwards.
"""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as xml
import zlib
from xml.sax.saxutils import quoteattr

import numpy as np

from tessera.errors import FileFormatError, ImageTypeError
from tessera.functions.geo import GeoTransform
from tessera.sources.info import GeoInfo

#: Sample format and bits of a base type; struct letters of the field types; compression schemes.
TYPES = {(1, 8): "uint8", (2, 8): "int8", (1, 16): "uint16", (2, 16): "int16", (2, 32): "int32", (3, 32): "float32", (3, 64): "float64"}
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
SCHEMES = {None: NONE, "none": NONE, "lzw": LZW, "deflate": DEFLATE}
CLEAR, END, FIRST = 256, 257, 258
GCP = tuple[str, str, float, float, float, float, float]


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, as TIFF readers expect them."""
    out, acc, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    table: dict[tuple[int, int], int] = {}
    free, width, prefix = FIRST, 9, -1
    put(CLEAR, width)
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        known = table.get((prefix, byte))
        if known is not None:
            prefix = known
            continue
        put(prefix, width)
        table[prefix, byte] = free
        free += 1
        if free == 4094:
            put(CLEAR, width)
            table, free, width = {}, FIRST, 9
        elif free >> width:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix, width)
        free += 1
        if free == 4094:
            put(CLEAR, width)
            width = 9
        elif free >> width:
            width += 1
    put(END, width)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, acc, held, width = bytearray(), 0, 0, 9
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last = list(single), b""
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == END:
            break
        if code == CLEAR:
            table, last, width = list(single), b"", 9
            continue
        if code > len(table) or (code == len(table) and not last):
            raise FileFormatError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        # a writer is one entry ahead, so the width grows one entry early
        if len(table) + 1 >> width and width < 12:
            width += 1
    return bytes(out)


def pack(block: np.ndarray, scheme: int, predictor: bool) -> bytes:
    """One block (rows, columns, samples), coded."""
    block = np.ascontiguousarray(block)
    if predictor:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    raw = block.astype(block.dtype.newbyteorder("<")).tobytes()
    return raw if scheme == NONE else lzw_encode(raw) if scheme == LZW else zlib.compress(raw)


def unpack(raw: bytes, scheme: int, predictor: int, dtype: np.dtype, shape: tuple[int, int, int]) -> np.ndarray:
    if scheme == LZW:
        raw = lzw_decode(raw)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif scheme != NONE:
        raise FileFormatError(f"compression {scheme} isn't read")
    if predictor not in (1, 2):
        raise FileFormatError(f"predictor {predictor} isn't read")
    rows, columns, samples = shape
    if len(raw) < rows * columns * samples * dtype.itemsize:
        raise FileFormatError("a block is too short")
    block = np.frombuffer(raw, dtype, rows * columns * samples).reshape(shape).astype(dtype.newbyteorder("="))
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def _geo_entries(info: GeoInfo) -> list[tuple[int, int, list]]:
    entries: list[tuple[int, int, list]] = []
    g = info.geotransform
    if not g.identity:
        entries.append((34264, 12, [g.dx, g.rx, 0, g.x0, g.ry, g.dy, 0, g.y0, 0, 0, 0, 0, 0, 0, 0, 1]))
    elif info.gcps:
        entries.append((33922, 12, [v for *_, px, line, x, y, z in info.gcps for v in (px, line, 0.0, x, y, z)]))
    if info.srs.upper().startswith("EPSG:"):
        code = int(info.srs[5:])
        geographic = 4000 <= code < 5000
        entries.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code]))
    if info.nodata and not math.isnan(info.nodata[0]):
        entries.append((42113, 2, list(f"{info.nodata[0]:.17g}\0".encode())))
    items = "".join(f"<Item name={quoteattr(k)} domain={quoteattr(d)}>{_escaped(v)}</Item>" for d, of in info.metadata.items() for k, v in of.items())
    if items:
        entries.append((42112, 2, list(f"<GDALMetadata>{items}</GDALMetadata>\0".encode())))
    return entries


def _escaped(text: str) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def assemble(blocks: list[bytes], info: GeoInfo, scheme: int, predictor: bool, tile: int | None) -> bytes:
    """A one-page file of coded blocks in row-major order; without ``tile`` the only block is a strip."""
    kind, bits = next(k for k, v in TYPES.items() if v == info.base_type)
    at, offsets, body = 8, [], []
    for b in blocks:
        offsets.append(at)
        body.append(b + b"\0" * (len(b) % 2))
        at += len(body[-1])
    photometric = 3 if info.color_table else 1
    entries: list[tuple[int, int, list]] = [
        (256, 4, [info.width]), (257, 4, [info.height]), (258, 3, [bits] * info.bands), (259, 3, [scheme]), (262, 3, [photometric]),
        (277, 3, [info.bands]), (284, 3, [1]), (317, 3, [2 if predictor else 1]), (339, 3, [kind] * info.bands),
    ]
    sizes = [len(b) for b in blocks]
    if tile is None:
        entries += [(273, 4, offsets), (278, 4, [info.height]), (279, 4, sizes)]
    else:
        entries += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, sizes)]
    if info.color_table:
        full = [*info.color_table, *[(0, 0, 0, 255)] * (256 - len(info.color_table))]
        entries.append((320, 3, [c[i] * 257 for i in range(3) for c in full]))
    entries += _geo_entries(info)
    extra_at, extra, rows = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, code, values in sorted(entries, key=lambda e: e[0]):
        data = bytes(values) if code == 2 else struct.pack("<" + FIELDS[code] * len(values), *values)
        if len(data) <= 4:
            rows += struct.pack("<HHI", tag, code, len(values)) + data.ljust(4, b"\0")
        else:
            rows += struct.pack("<HHII", tag, code, len(values), extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(body) + struct.pack("<H", len(entries)) + rows + struct.pack("<I", 0) + extra


def tiles_of(pixels: np.ndarray, tile: int | None) -> list[np.ndarray]:
    """Blocks (rows, columns, samples) of (bands, height, width); tiles are filled up by their edge."""
    whole = pixels.transpose(1, 2, 0)
    if tile is None:
        return [whole]
    h, w = whole.shape[:2]
    whole = np.pad(whole, ((0, -h % tile), (0, -w % tile), (0, 0)), mode="edge")
    return [whole[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]


def encode(pixels: np.ndarray, info: GeoInfo | None = None, compress: str | None = "lzw", predictor: bool = False, tile: int | None = None) -> bytes:
    """A GeoTIFF of (bands, height, width); tiles have sides of a multiple of 16."""
    bands, height, width = pixels.shape
    named = GeoInfo(width, height, bands, str(pixels.dtype)) if info is None else GeoInfo(width, height, bands, str(pixels.dtype), info.nodata, info.geotransform, info.srs, info.color_table, info.metadata, info.gcps)
    if tile is not None and (tile <= 0 or tile % 16):
        raise FileFormatError("the side of a tile is a multiple of 16")
    if predictor and pixels.dtype.kind == "f":
        raise FileFormatError("floats are not predicted")
    scheme = SCHEMES[compress]
    return assemble([pack(b, scheme, predictor) for b in tiles_of(pixels, tile)], named, scheme, predictor, tile)


def _pages(blob: bytes) -> tuple[str, list[dict[int, list]]]:
    if blob[:4] not in (b"II*\0", b"MM\0*"):
        raise FileFormatError("not a TIFF file")
    e = "<" if blob[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", blob, 4)
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", blob, at)
        tags: dict[int, list] = {}
        for i in range(n):
            tag, code, count = struct.unpack_from(e + "HHI", blob, at + 2 + 12 * i)
            if code not in FIELDS:
                continue
            form = e + FIELDS[code] * count
            where = at + 2 + 12 * i + 8
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(e + "I", blob, where)
            tags[tag] = [blob[where : where + count]] if code == 2 else list(struct.unpack_from(form, blob, where))
        pages.append(tags)
        (at,) = struct.unpack_from(e + "I", blob, at + 2 + 12 * n)
    return e, pages


def _info(tags: dict[int, list]) -> GeoInfo:
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    kinds = {(f, b) for f, b in zip(tags.get(339, [1] * bands), tags.get(258, [1] * bands), strict=False)}
    if len(kinds) != 1 or next(iter(kinds)) not in TYPES:
        raise ImageTypeError(f"bands of types {kinds} can't be read together")
    t, transform, gcps = tags.get(34264), GeoTransform(), ()
    if t:
        transform = GeoTransform(t[3], t[0], t[1], t[7], t[4], t[5])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        transform = GeoTransform(x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    elif 33922 in tags:
        ties = tags[33922]
        gcps = tuple((str(k // 6 + 1), "", *ties[k : k + 2], *ties[k + 3 : k + 6]) for k in range(0, len(ties), 6))
    nodata = (float(tags[42113][0].split(b"\0")[0]),) * bands if 42113 in tags else ()
    table = tags.get(320)
    colors = tuple((table[i] >> 8, table[i + len(table) // 3] >> 8, table[i + 2 * len(table) // 3] >> 8, 255) for i in range(len(table) // 3)) if table else ()
    keys = tags.get(34735, [])
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = codes.get(3072) or codes.get(2048)
    metadata: dict[str, dict[str, str]] = {}
    if 42112 in tags:
        for item in xml.fromstring(tags[42112][0].split(b"\0")[0].decode()):
            metadata.setdefault(item.get("domain", ""), {})[item.get("name", "")] = item.text or ""
    return GeoInfo(width, height, bands, TYPES[next(iter(kinds))], nodata, transform, f"EPSG:{code}" if code else "", colors, metadata, gcps)


def infos(blob: bytes) -> list[GeoInfo]:
    """What each page says of itself, without its pixels."""
    return [_info(t) for t in _pages(blob)[1]]


def decode(blob: bytes, page: int = 0) -> tuple[np.ndarray, GeoInfo]:
    """Pixels (bands, height, width) of a page, and what it says of itself."""
    e, pages = _pages(blob)
    if not 0 <= page < len(pages):
        raise FileFormatError(f"there is no page {page}")
    tags = pages[page]
    info = _info(tags)
    scheme, predictor = tags.get(259, [NONE])[0], tags.get(317, [1])[0]
    dtype = np.dtype(info.base_type).newbyteorder(e)
    planes = tags.get(284, [1])[0] == 2
    samples = 1 if planes else info.bands
    tiled = 324 in tags
    high, wide = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, [info.height])[0], info.height), info.width)
    down, across = -(-info.height // high), -(-info.width // wide)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.empty((info.bands, down * high, across * wide), dtype.newbyteorder("="))
    for n, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(n, down * across)
        y, x = place // across * high, place % across * wide
        rows = high if tiled else min(high, info.height - y)
        block = unpack(blob[at : at + size], scheme, predictor, dtype, (rows, wide, samples)).transpose(2, 0, 1)
        out[plane : plane + 1 if planes else None, y : y + rows, x : x + wide] = block
    return np.ascontiguousarray(out[:, : info.height, : info.width]), info


def joined(files: list[bytes]) -> bytes:
    """One file with the pages of several one-page files of this module."""
    out, links = b"", []
    for f in files:
        base = len(out)
        e, _ = _pages(f)
        body = bytearray(f)
        (at,) = struct.unpack_from(e + "I", f, 4)
        (n,) = struct.unpack_from(e + "H", f, at)
        for i in range(n):
            tag, code, count = struct.unpack_from(e + "HHI", f, at + 2 + 12 * i)
            where = at + 2 + 12 * i + 8
            long_ = struct.calcsize(e + FIELDS[code] * count) > 4
            if long_:
                (to,) = struct.unpack_from(e + "I", f, where)
                struct.pack_into(e + "I", body, where, to + base)
            if tag in (273, 324):
                for k in range(count):
                    spot = to + 4 * k if long_ else where
                    struct.pack_into(e + "I", body, spot, struct.unpack_from(e + "I", f, spot)[0] + base)
        links.append((base + at, base + at + 2 + 12 * n))
        out += bytes(body) + b"\0" * (len(body) % 2)
    whole = bytearray(out)
    struct.pack_into("<I", whole, 4, links[0][0])
    for (_, link), (after, _) in zip(links, links[1:], strict=False):
        struct.pack_into("<I", whole, link, after)
    return bytes(whole)
