"""What is known of an image besides its pixels."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tessera.errors import InvalidArgument, NotFound, SizeError
from tessera.functions.geo import GeoTransform, Rectangle


@dataclass(frozen=True)
class GeoInfo:
    """``gcps`` are (id, info, pixel, line, x, y, z); ``metadata`` maps domains to their items."""

    width: int
    height: int
    bands: int
    base_type: str
    nodata: tuple[float, ...] = ()
    geotransform: GeoTransform = GeoTransform()
    srs: str = ""
    color_table: tuple[tuple[int, int, int, int], ...] = ()
    metadata: dict = field(default_factory=dict)
    gcps: tuple = ()

    def cropped(self, area: Rectangle) -> GeoInfo:
        """Of a window of the image; a width or height of 0 reaches to the edge."""
        w, h = area.width or self.width - area.x, area.height or self.height - area.y
        if area.x < 0 or area.y < 0 or area.x + w > self.width or area.y + h > self.height:
            raise SizeError("the crop leaves the image")
        moved = tuple((i, t, px - area.x, line - area.y, *rest) for i, t, px, line, *rest in self.gcps)
        return replace(self, width=int(w), height=int(h), geotransform=self.geotransform.translate_image(area.x, area.y), gcps=moved)

    def with_bands(self, bands: list[int]) -> GeoInfo:
        if any(not 0 <= b < self.bands for b in bands):
            raise InvalidArgument(f"no such band in {bands}")
        return replace(self, bands=len(bands), nodata=tuple(self.nodata[b] for b in bands) if self.nodata else ())

    def flipped(self, horizontal: bool, vertical: bool) -> GeoInfo:
        return replace(self, geotransform=self.geotransform.flip_image(horizontal, vertical, self.width, self.height))

    def extents(self) -> Rectangle:
        return Rectangle(0, 0, self.width, self.height).project(self.geotransform)

    def with_extents(self, extents: Rectangle) -> GeoInfo:
        """The same pixels spread over other extents: north up, without rotation."""
        t = GeoTransform(extents.x, extents.width / self.width, 0.0, extents.y + extents.height, 0.0, -extents.height / self.height)
        return replace(self, geotransform=t)

    def intersected(self, other: GeoInfo) -> Rectangle:
        """The rectangle of this image's pixels that the other one covers too, in whole pixels."""
        meet = self.extents() & other.extents()
        corners = [self.geotransform.projection_to_image(meet.x + a * meet.width, meet.y + b * meet.height) for a in (0, 1) for b in (0, 1)]
        xs, ys = ([round(v) for v in c] for c in zip(*corners, strict=True))
        return Rectangle(min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)) if meet.width and meet.height else Rectangle(0, 0, 0, 0)

    def same_colors(self, other: GeoInfo) -> bool:
        """Whether palettes agree; entries after the end of the shorter one have to be black."""
        short, long_ = sorted((self.color_table, other.color_table), key=len)
        return short == long_[: len(short)] and all(c[:3] == (0, 0, 0) for c in long_[len(short) :])

    # metadata by domain; the empty one is the common one
    def item(self, key: str, domain: str = "") -> str:
        if key not in self.metadata.get(domain, {}):
            raise NotFound(f"no item {key!r} in domain {domain!r}")
        return self.metadata[domain][key]

    def with_item(self, key: str, value: str, domain: str = "") -> GeoInfo:
        return replace(self, metadata={**self.metadata, domain: {**self.metadata.get(domain, {}), key: value}})

    def without_items(self, domain: str, key: str | None = None) -> GeoInfo:
        """Without one item, or without a whole domain."""
        left = {} if key is None else {k: v for k, v in self.metadata.get(domain, {}).items() if k != key}
        rest = {d: of for d, of in self.metadata.items() if d != domain}
        return replace(self, metadata={**rest, domain: left} if left else rest)

    def of_prediction(self, area: Rectangle | None, source: str = "") -> GeoInfo:
        """For the prediction of an area of this image: moved and cut to it; empty sides are the whole image's."""
        cut = self if area is None else self.cropped(area)
        return cut.with_item("SOURCE", source) if source else cut
