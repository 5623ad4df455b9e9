"""Copies of images by local descriptors.

An image (binary PGM, or PNG without interlacing, 8 bits a channel) is looked at in
``SCALES`` sizes.  Each gives the strongest Harris corners of every square of ``FIELD``
pixels; a corner's patch is turned by the direction of its intensity centroid and
described by ``TESTS`` comparisons of pairs of means over five by five pixels.  The 128
bits are cut into two keys: descriptors at a Hamming distance of 1 or less share one of
them, others by chance.  An edit that changes more bits of most descriptors hides a
copy; enough corners survive crops, turns by right angles, scales, tone changes and
noise (recall of each in the README).  Images that share keys are candidates; they are
copies if at least ``CONSENSUS`` distinct matches agree on one rotation, scale and
shift, voted on two overlapping grids.

A pair of copies has ``CONSENSUS`` or more keypoints on either side whose keys the
other has.  With an image's shared keys in the order of how often they occur, the
rarest one that such a pair shares comes before the last ``CONSENSUS`` - 1 entries of
both, so pairs meet under the other entries alone; each then counts the keys it shares
in full, and all matches of those that share enough vote.  No pair of a bucket is left
out, however large it is.  Images equal in every pixel are one image with a weight.
Copies are connected.

Null, unreadable or featureless images have no keypoints and are alone, but for
exact copies of readable ones; images smaller than a patch have none; ids that
repeat, with one picture or several, are reported row by row; a null id is reported,
but lends none to a component; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.frames import map_batches, settle, spread

SCALES = (1.0, 0.75, 0.5)
#: Corners taken in each square of FIELD x FIELD pixels, and how many are described at a time.
CORNERS = 24
FIELD = 64
AT_ONCE = 4096
RADIUS = 9
TESTS = 128
NEAR = 24
CONSENSUS = 4
_rng = np.random.default_rng(7)
_TESTS = np.clip(_rng.uniform(-RADIUS, RADIUS, (TESTS, 4)), -RADIUS + 2, RADIUS - 2)
_HEAD = re.compile(rb"^P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")
PNG = b"\x89PNG\r\n\x1a\n"
POINT = "x: float, y: float, scale: float, angle: float, b0: bigint, b1: bigint"


def to_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def from_pgm(blob: bytes | None) -> np.ndarray | None:
    head = _HEAD.match(blob or b"")
    if not head:
        return None
    w, h = int(head[1]), int(head[2])
    body = blob[head.end() :]
    return np.frombuffer(body, np.uint8, w * h).reshape(h, w) if w and h and len(body) >= w * h else None


def to_png(pixels: np.ndarray) -> bytes:
    """Gray (H, W) or colour (H, W, 3) pixels of 8 bits."""
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.column_stack([np.zeros(h, np.uint8), rows]).tobytes())) + chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; ``step`` bytes make a pixel."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, (kind, row) in enumerate(zip(raw[:, 0], raw[:, 1:], strict=True)):
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            now, up = row.astype(int).tolist(), above.tolist()
            for i in range(len(now)):
                left = now[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    corner = up[i - step] if i >= step else 0
                    base = left + up[i] - corner
                    guess = min((abs(base - left), 0, left), (abs(base - up[i]), 1, up[i]), (abs(base - corner), 2, corner))[2]
                now[i] = (now[i] + guess) & 255
            row = np.array(now, np.uint8)
        elif kind:
            raise ValueError("no such filter")
        out[y] = above = row
    return out


def from_png(blob: bytes) -> np.ndarray | None:
    """Brightness of a PNG of 8 bits a channel, without interlacing; None if it is another or broken."""
    at, data, palette, head = 8, [], None, None
    try:
        while at < len(blob):
            size, kind = struct.unpack_from(">I4s", blob, at)
            body = blob[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                data.append(body)
            at += 12 + size
        w, h, depth, color, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth != 8 or interlaced or not w or not h:
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * channels)
        pixels = _unfiltered(raw, channels).reshape(h, w, channels)
        if color == 3:
            pixels = palette[pixels[..., 0]]
    except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
        return None
    return pixels[..., 0] if color in (0, 4) else np.rint(pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def decoded(blob: bytes | None) -> np.ndarray | None:
    return from_png(blob) if blob and blob[:8] == PNG else from_pgm(blob)


def _resize(n: int, factor: float) -> np.ndarray:
    """Rows of weights that average n cells down to round(n x factor)."""
    m = max(1, round(n * factor))
    edge = np.linspace(0, n, m + 1)
    cell = np.arange(n)
    return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None) * m / n


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over windows of 2r + 1 along both axes of (B, H, W)."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad), axis=axis)
        n = a.shape[axis]
        a = np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)
    return a


def keypoints(images: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """image index, x, y, scale, angle and bits of the corners of (B, H, W) images, for each scale."""
    out = []
    for scale in SCALES:
        small = images if scale == 1 else _resize(images.shape[1], scale) @ images @ _resize(images.shape[2], scale).T
        _, h, w = small.shape
        edge = RADIUS + 1
        if min(h, w) <= 2 * edge:
            continue
        dy, dx = np.gradient(small, axis=1), np.gradient(small, axis=2)
        xx, yy, xy = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = np.ones(strength.shape, bool)
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                if (sy, sx) != (0, 0):
                    shifted = np.roll(strength, (sy, sx), (1, 2))
                    peak &= strength >= shifted if (sy, sx) > (0, 0) else strength > shifted
        inner = np.zeros_like(peak)
        inner[:, edge:-edge, edge:-edge] = peak[:, edge:-edge, edge:-edge]
        value = np.where(inner & (strength > 1.0), strength, -np.inf)
        found = []
        for top in range(0, h, FIELD):
            for left in range(0, w, FIELD):
                field = value[:, top : top + FIELD, left : left + FIELD]
                wide, field = field.shape[2], field.reshape(len(small), -1)
                k = min(CORNERS, field.shape[1])
                at = np.argpartition(-field, k - 1, axis=1)[:, :k]
                i, c = np.nonzero(np.isfinite(np.take_along_axis(field, at, 1)))
                found.append((i, top + at[i, c] // wide, left + at[i, c] % wide))
        every = [np.concatenate(x) for x in zip(*found, strict=True)]
        span = np.arange(-RADIUS, RADIUS + 1)
        disc = (span[:, None] ** 2 + span[None, :] ** 2 <= RADIUS**2).astype(np.float32)
        blurred = _box(small, 2)
        for j in range(0, len(every[0]), AT_ONCE):
            b, y, x = (e[j : j + AT_ONCE] for e in every)
            patch = small[b[:, None, None], y[:, None, None] + span[:, None], x[:, None, None] + span[None, :]] * disc
            angle = np.arctan2((patch * span[:, None]).sum((1, 2)), (patch * span).sum((1, 2)))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

            def probe(px: np.ndarray, py: np.ndarray, b=b, x=x, y=y, cos=cos, sin=sin, blurred=blurred) -> np.ndarray:
                return blurred[b[:, None], y[:, None] + np.rint(sin * px + cos * py).astype(int), x[:, None] + np.rint(cos * px - sin * py).astype(int)]

            bits = np.packbits(probe(_TESTS[:, 0], _TESTS[:, 1]) < probe(_TESTS[:, 2], _TESTS[:, 3]), axis=1)
            out.append((b, (x + 0.5) / scale, (y + 0.5) / scale, np.full(len(b), scale), angle, bits))
    return out


def described(images: DataFrame) -> DataFrame:
    """id, digest of the pixels (null if unreadable), points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                pixels = [decoded(v.as_py()) for v in part.column("image")]
                digest = [xxhash.xxh3_64_intdigest(repr(p.shape).encode() + p.tobytes()) - (1 << 63) if p is not None else None for p in pixels]
                shapes: dict[tuple[int, int], list[int]] = {}
                for n, p in enumerate(pixels):
                    if p is not None:
                        shapes.setdefault(p.shape, []).append(n)
                found = [(np.array(rows)[b], *rest) for rows in shapes.values() for b, *rest in keypoints(np.stack([pixels[n] for n in rows]).astype(np.float32))]
                owner, x, y, scale, angle, bits = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), *np.zeros((4, 0)), np.zeros((0, TESTS // 8), np.uint8))
                order = np.argsort(owner, kind="stable")
                two = np.ascontiguousarray(bits[order]).view(np.int64).reshape(-1, 2)
                fields = [pa.array(c[order].astype(np.float32)) for c in (x, y, scale, angle)] + [pa.array(two[:, 0]), pa.array(two[:, 1])]
                bounds = pa.array(np.searchsorted(owner[order], np.arange(len(pixels) + 1)).astype(np.int32))
                points = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, names=["x", "y", "scale", "angle", "b0", "b1"]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digest, pa.int64()), points], names=["id", "digest", "points"])

    return map_batches(images.select(F.col("id").cast("long").alias("id"), "image"), run, f"id long, digest long, points array<struct<{POINT}>>")


def _bits_apart(a: str, b: str):
    """Hamming distance of two 128-bit strings held as two longs each."""
    return F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))


def copies(images: DataFrame) -> DataFrame:
    """id, n_keypoints, component_id, n_links of every image (id, image)."""
    table = settle(described(images))
    classes = table.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("points").alias("points"))
    points = settle(classes.select(F.col("digest").alias("im"), F.posexplode("points").alias("no", "p")).select("im", "no", "p.*"))
    keys = F.array(*[F.xxhash64(F.lit(c), F.col(c)) for c in ("b0", "b1")])
    shelf = points.select("im", "no", F.explode(keys).alias("key"))
    # keys of one image alone are shared by no pair
    often = shelf.groupBy("key").agg(F.count("*").alias("often"), F.min("im").alias("low"), F.max("im").alias("high")).filter("low < high").select("key", "often")
    held = shelf.join(often, "key").groupBy("im").agg(F.array_sort(F.collect_list(F.struct("often", "key", "no"))).alias("held"))
    held = settle(held.filter(F.size("held") >= CONSENSUS))
    # of the keys a pair shares, the rarest comes before the last CONSENSUS - 1 entries of either image
    least = held.select("im", F.explode(F.array_distinct(F.slice("held.key", F.lit(1), F.size("held") - (CONSENSUS - 1)))).alias("key"))
    near = least.withColumnRenamed("im", "a").join(least.withColumnRenamed("im", "b"), "key").filter("a < b").select("a", "b").distinct()
    own = lambda s: held.select(F.col("im").alias(s), F.col("held.key").alias(f"{s}_keys"))
    common = lambda s, t: F.size(F.filter(f"{s}_keys", lambda k: F.array_contains(f"{t}_keys", k))) >= CONSENSUS
    near = settle(near.join(own("a"), "a").join(own("b"), "b").filter(common("a", "b") & common("b", "a")).select("a", "b"))
    entry = lambda s: held.select(F.col("im").alias(s), F.explode("held").alias("e")).select(s, F.col("e.key").alias("key"), F.col("e.no").alias(f"{s}_no"))
    pair = near.join(entry("a"), "a").join(entry("b"), ["b", "key"]).select("a", "a_no", "b", "b_no").distinct()
    side = lambda s: points.select(F.col("im").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("no", "x", "y", "scale", "angle", "b0", "b1")])
    flat = pair.join(side("a"), ["a", "a_no"]).join(side("b"), ["b", "b_no"])
    flat = flat.filter(_bits_apart("a_b", "b_b") <= NEAR)
    turn, grow = F.col("b_angle") - F.col("a_angle"), F.col("a_scale") / F.col("b_scale")
    flat = flat.withColumn("turn", F.pmod(turn + 6.283185307, F.lit(6.283185307))).withColumn("grow", F.log2(grow))
    flat = flat.withColumn("dx", F.col("b_x") - grow * (F.cos(turn) * F.col("a_x") - F.sin(turn) * F.col("a_y"))).withColumn("dy", F.col("b_y") - grow * (F.sin(turn) * F.col("a_x") + F.cos(turn) * F.col("a_y")))
    votes = flat.withColumn("grid", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    cell = lambda c, width: F.floor(F.col(c) / width + F.col("grid"))
    ballot = votes.groupBy("a", "b", "grid", F.pmod(cell("turn", 0.5235987756), F.lit(12)).alias("t"), cell("grow", 0.6).alias("s"), cell("dx", 10.0).alias("u"), cell("dy", 10.0).alias("v"))
    links = settle(ballot.agg(F.countDistinct("a_no").alias("n"), F.countDistinct("b_no").alias("m")).filter(F.least("n", "m") >= CONSENSUS).select("a", "b").distinct())
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = classes.select("digest", "id", "weight").join(roots.withColumnRenamed("u", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    known = known.join(known.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(classes.select(F.col("digest").alias("b"), "weight"), "b").groupBy(F.col("a").alias("digest")).agg(F.sum("weight").alias("others"))
    known = known.join(partners, "digest", "left").select("digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = table.select("id", "digest", F.size("points").alias("n_keypoints")).join(known, "digest", "left")
    return out.select("id", "n_keypoints", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


SIDE = 64
#: Edits that planted copies show, by the last digit of the id.
EDITS = {1: "crop", 2: "turn", 3: "scale", 4: "tone", 5: "noise"}


def picture(vector: np.ndarray) -> np.ndarray:
    """A vector as rectangles whose places, sizes and grays are digits of its components."""
    digits = np.mod(np.abs(np.concatenate([vector * 1009, vector * 331.7])), 1.0)
    digits = np.resize(digits, (max(1, len(digits) // 4), 4))
    out = np.full((SIDE, SIDE), 128.0)
    for y, x, size, gray in digits.tolist():
        top, left = int(y * (SIDE - 4)), int(x * (SIDE - 4))
        out[top : top + 4 + int(size * 18), left : left + 4 + int(size * 7919 % 1 * 18)] = round(gray * 255)
    return out


def edited(pixels: np.ndarray, edit: str | None) -> np.ndarray:
    if edit == "crop":
        return pixels[5 : SIDE - 3, 3 : SIDE - 5]
    if edit == "turn":
        return np.rot90(pixels)
    if edit == "scale":
        return np.rint(_resize(SIDE, 0.75) @ pixels @ _resize(SIDE, 0.75).T)
    if edit == "tone":
        return np.rint(pixels * 0.8 + 20)
    if edit == "noise":
        seed = zlib.crc32(pixels.tobytes())
        return np.clip(np.rint(pixels + np.random.default_rng(seed).normal(0, 5, pixels.shape)), 0, 255)
    return pixels


def painted(vectors: DataFrame) -> DataFrame:
    """id and image of every vector, as a media column to scan.

    An id that ends in 0 is painted from its vector; the five after it, if that id is
    there, are its copies, edited as ``EDITS`` says, every second one of them as PNG.  Others
    are painted from their own vectors.  Missing and non-finite components are 0.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("own"))
    digit = F.pmod("id", F.lit(10))
    lent = rows.filter(digit == 0).groupBy(F.col("id").alias("source")).agg(F.min("own").alias("other"))
    planted = digit.isin(*EDITS) & F.col("id").isNotNull()
    copies_ = rows.filter(planted).withColumn("source", F.col("id") - digit).join(lent, "source", "left").drop("source")
    rows = copies_.unionByName(rows.filter(~F.coalesce(planted, F.lit(False))).withColumn("other", F.lit(None).cast("array<double>")))
    # few bytes make much work here: as many tasks as the session deals in
    rows = spread(rows, "id", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for i, own, other in zip(*(batch.column(c) for c in ("id", "own", "other")), strict=True):
                v, edit = (other, EDITS[i.as_py() % 10]) if other.is_valid else (own, None)
                x = np.array([e if e is not None and np.isfinite(e) else 0.0 for e in v.as_py()], float) if v.is_valid else np.zeros(0)
                if not len(x):
                    blobs.append(None)
                    continue
                pixels = edited(picture(x), edit)
                blobs.append(to_png(pixels) if edit and i.as_py() % 2 else to_pgm(pixels))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], names=["id", "image"])

    return map_batches(rows.select("id", "own", "other"), run, "id long, image binary")
