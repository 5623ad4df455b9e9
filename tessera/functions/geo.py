"""Affine geotransforms: six coefficients (x0, dx, rx, y0, ry, dy)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column

from tessera.errors import InvalidArgument


@dataclass(frozen=True)
class GeoTransform:
    x0: float = 0.0
    dx: float = 1.0
    rx: float = 0.0
    y0: float = 0.0
    ry: float = 0.0
    dy: float = 1.0

    def image_to_projection(self, x, y):
        """Works on numbers and on columns."""
        return x * self.dx + y * self.rx + self.x0, x * self.ry + y * self.dy + self.y0

    def projection_to_image(self, px, py):
        det = self.dx * self.dy - self.rx * self.ry
        if det == 0:
            raise InvalidArgument("the transform can't be inverted")
        a, b = px - self.x0, py - self.y0
        return (a * self.dy - b * self.rx) / det, (b * self.dx - a * self.ry) / det

    @property
    def identity(self) -> bool:
        return self == GeoTransform()

    def scale_image(self, sx: float, sy: float) -> GeoTransform:
        return replace(self, dx=self.dx * sx, rx=self.rx * sy, ry=self.ry * sx, dy=self.dy * sy)

    def scale_projection(self, sx: float, sy: float) -> GeoTransform:
        return GeoTransform(self.x0 * sx, self.dx * sx, self.rx * sx, self.y0 * sy, self.ry * sy, self.dy * sy)

    def rotate_projection(self, degrees: float) -> GeoTransform:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        turn = lambda a, b: (c * a - s * b, s * a + c * b)
        (x0, y0), (dx, ry), (rx, dy) = turn(self.x0, self.y0), turn(self.dx, self.ry), turn(self.rx, self.dy)
        return GeoTransform(x0, dx, rx, y0, ry, dy)

    def rotate_image(self, degrees: float) -> GeoTransform:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return replace(self, dx=self.dx * c + self.rx * s, rx=self.rx * c - self.dx * s, ry=self.ry * c + self.dy * s, dy=self.dy * c - self.ry * s)

    def shear_x_image(self, f: float) -> GeoTransform:
        return replace(self, rx=self.rx + f * self.dx, dy=self.dy + f * self.ry)

    def shear_y_image(self, f: float) -> GeoTransform:
        return replace(self, dx=self.dx + f * self.rx, ry=self.ry + f * self.dy)

    def shear_x_projection(self, f: float) -> GeoTransform:
        return replace(self, x0=self.x0 + f * self.y0, dx=self.dx + f * self.ry, rx=self.rx + f * self.dy)

    def shear_y_projection(self, f: float) -> GeoTransform:
        return replace(self, y0=self.y0 + f * self.x0, ry=self.ry + f * self.dx, dy=self.dy + f * self.rx)

    def translate_image(self, x: float, y: float) -> GeoTransform:
        x0, y0 = self.image_to_projection(x, y)
        return replace(self, x0=x0, y0=y0)

    def translate_projection(self, x: float, y: float) -> GeoTransform:
        return replace(self, x0=self.x0 + x, y0=self.y0 + y)

    def flip_image(self, horizontal: bool, vertical: bool, width: int, height: int) -> GeoTransform:
        out = self
        if horizontal:
            out = out.translate_image(width, 0).scale_image(-1, 1)
        return out.translate_image(0, height).scale_image(1, -1) if vertical else out


@dataclass(frozen=True)
class Rectangle:
    x: float
    y: float
    width: float
    height: float

    def __and__(self, o: Rectangle) -> Rectangle:
        """Intersection; empty if they don't meet."""
        x, y = max(self.x, o.x), max(self.y, o.y)
        w, h = min(self.x + self.width, o.x + o.width) - x, min(self.y + self.height, o.y + o.height) - y
        return Rectangle(x, y, w, h) if w > 0 and h > 0 else Rectangle(x, y, 0, 0)

    def contains(self, x: Column, y: Column) -> Column:
        return (x >= self.x) & (x < self.x + self.width) & (y >= self.y) & (y < self.y + self.height)

    def grown(self, margin: int) -> Rectangle:
        """With a halo, for inputs of a window operator."""
        return Rectangle(self.x - margin, self.y - margin, self.width + 2 * margin, self.height + 2 * margin)

    def project(self, t: GeoTransform) -> Rectangle:
        """The bounding rectangle in projection space."""
        corners = [t.image_to_projection(a, b) for a in (self.x, self.x + self.width) for b in (self.y, self.y + self.height)]
        xs, ys = zip(*corners, strict=True)
        return Rectangle(min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))
