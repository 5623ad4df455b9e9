"""Spatial reference systems as column arithmetic: geographic, spherical Mercator and UTM, all WGS 84.

Other systems need a library of projections; ``register`` takes their two functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import NotImplementedFeature
from tessera.functions.geo import GeoTransform

Mapping = Callable[[Column, Column], tuple[Column, Column]]
#: The ellipsoid of WGS 84 and the scale and false origins of UTM.
A, FLAT = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
_own: dict[str, tuple[Mapping, Mapping]] = {}


def register(srs: str, to_lonlat: Mapping, from_lonlat: Mapping) -> None:
    """Teach the module another system, with degrees of longitude and latitude on the other side."""
    _own[srs.upper()] = (to_lonlat, from_lonlat)


def _mercator() -> tuple[Mapping, Mapping]:
    def back(x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / A), F.degrees(F.atan(F.exp(y / A)) * 2 - math.pi / 2)

    def forth(lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A

    return back, forth


def _utm(zone: int, south: bool) -> tuple[Mapping, Mapping]:
    """Krueger's series to the third order of the third flattening: below a millimetre within a zone."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    middle, origin = zone * 6 - 183, SOUTH if south else 0.0
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2

    def forth(lon: Column, lat: Column) -> tuple[Column, Column]:
        sine, away = F.sin(F.radians(lat)), F.radians(lon - middle)
        t = F.sinh(atanh(sine) - atanh(sine * e) * e)
        xi, eta = F.atan2(t, F.cos(away)), atanh(F.sin(away) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x = x + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
            y = y + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
        return x * (SCALE * radius) + EAST, y * (SCALE * radius) + origin

    def back(x: Column, y: Column) -> tuple[Column, Column]:
        eta, xi = (x - EAST) / (SCALE * radius), (y - origin) / (SCALE * radius)
        p, q = xi, eta
        for j, b in enumerate(beta, 1):
            p = p - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
            q = q - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
        chi = F.asin(F.sin(p) / F.cosh(q))
        lat = chi
        for j, d in enumerate(delta, 1):
            lat = lat + F.sin(chi * 2 * j) * d
        return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + middle, F.degrees(lat)

    return back, forth


def mappings(srs: str) -> tuple[Mapping, Mapping]:
    """(to longitude and latitude, from them) of a system named EPSG:n."""
    name = srs.upper()
    if name in _own:
        return _own[name]
    code = int(name[5:]) if name.startswith("EPSG:") and name[5:].isdigit() else 0
    if code == 4326:
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if code == 3857:
        return _mercator()
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return _utm(code % 100, code >= 32700)
    raise NotImplementedFeature(f"{srs!r} isn't known; register its functions")


def projection_to_projection(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    if source.upper() == target.upper():
        return x, y
    return mappings(target)[1](*mappings(source)[0](x, y))


def image_to_longlat(x: Column, y: Column, transform: GeoTransform, srs: str) -> tuple[Column, Column]:
    return mappings(srs)[0](*transform.image_to_projection(x, y))


def longlat_to_image(lon: Column, lat: Column, transform: GeoTransform, srs: str) -> tuple[Column, Column]:
    return transform.projection_to_image(*mappings(srs)[1](lon, lat))


def image_to_image(x: Column, y: Column, source: GeoTransform, source_srs: str, target: GeoTransform, target_srs: str) -> tuple[Column, Column]:
    return target.projection_to_image(*projection_to_projection(*source.image_to_projection(x, y), source_srs, target_srs))
