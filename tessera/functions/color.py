"""Colour spaces and spectral indices as column expressions.

Bands are columns scaled to [0, 1] unless a function says otherwise; results are
in the usual units of the space and can be scaled to a type with ``to_type``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import SizeError
from tessera.model import base_type, saturate


def to_type(value: Column, dtype: str, signed: bool = False) -> Column:
    """Scale [0, 1] (or [-1, 1], if signed) to a type's range; unsigned types take an offset."""
    t = base_type(dtype)
    if not t.integral:
        return value
    if not signed:
        return saturate(value * t.high, dtype)
    return saturate(value * t.high, dtype) if t.low < 0 else saturate((value + 1) * (t.high / 2), dtype)


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def ycbcr(r: Column, g: Column, b: Column, delta: float = 0.5) -> tuple[Column, Column, Column]:
    y = gray(r, g, b)
    return y, (b - y) * 0.564 + delta, (r - y) * 0.713 + delta


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, delta: float = 0.5) -> tuple[Column, Column, Column]:
    return y + (cr - delta) * 1.403, y - (cr - delta) * 0.714 - (cb - delta) * 0.344, y + (cb - delta) * 1.773


#: Linear RGB with a D65 white to XYZ, and back.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
RGB = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)


def _linear(m: tuple, *v: Column) -> tuple[Column, ...]:
    return tuple(v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in m)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return _linear(XYZ, r, g, b)


def xyz_to_rgb(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return _linear(RGB, x, y, z)


def _curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116)


def _lightness(y: Column) -> Column:
    return F.when(y > 0.008856, F.cbrt(y) * 116 - 16).otherwise(y * 903.3)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y, z = xyz(r, g, b)
    x, z = x / WHITE[0], z / WHITE[2]
    return _lightness(y), (_curve(x) - _curve(y)) * 500, (_curve(y) - _curve(z)) * 200


def lab_to_rgb(l_: Column, a: Column, b: Column) -> tuple[Column, ...]:
    dark = l_ <= 903.3 * 0.008856
    y = F.when(dark, l_ / 903.3).otherwise(F.pow((l_ + 16) / 116, F.lit(3.0)))
    fy = F.when(dark, y * 7.787 + 16 / 116).otherwise((l_ + 16) / 116)
    back = lambda f: F.when(f <= 7.787 * 0.008856 + 16 / 116, (f - 16 / 116) / 7.787).otherwise(f * f * f)
    return xyz_to_rgb(back(fy + a / 500) * WHITE[0], y, back(fy - b / 200) * WHITE[2])


def luv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y, z = xyz(r, g, b)
    d = x + y * 15 + z * 3
    u, v = (F.when(d == 0, 0.0).otherwise(F.try_divide(c, d)) for c in (x * 4, y * 9))
    l_ = _lightness(y)
    return l_, l_ * 13 * (u - 0.19793943), l_ * 13 * (v - 0.46831096)


def luv_to_rgb(l_: Column, u: Column, v: Column) -> tuple[Column, ...]:
    y = F.when(l_ <= 8, l_ / 903.3).otherwise(F.pow((l_ + 16) / 116, F.lit(3.0)))
    up = F.when(l_ == 0, 0.0).otherwise(F.try_divide(u, l_ * 13)) + 0.19793943
    vp = F.when(l_ == 0, 0.0).otherwise(F.try_divide(v, l_ * 13)) + 0.46831096
    x = F.try_divide(y * 9 * up, vp * 4)
    return xyz_to_rgb(x, y, F.try_divide(y * (F.lit(12.0) - up * 3 - vp * 20), vp * 4))


def _hue(r: Column, g: Column, b: Column, top: Column, span: Column) -> Column:
    h = F.when(top == r, F.try_divide((g - b) * 60, span)).when(top == g, F.try_divide((b - r) * 60, span) + 120).otherwise(F.try_divide((r - g) * 60, span) + 240)
    h = F.coalesce(h, F.lit(0.0))
    return F.when(h < 0, h + 360).otherwise(h)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation, value."""
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    return _hue(r, g, b, top, span), F.when(top == 0, 0.0).otherwise(F.try_divide(span, top)), top


def hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    l_ = (top + low) / 2
    s = F.when(top == low, 0.0).when(l_ < 0.5, F.try_divide(top - low, top + low)).otherwise(F.try_divide(top - low, F.lit(2.0) - top - low))
    return _hue(r, g, b, top, top - low), l_, s


def _sextant(h: Column, top: Column, low: Column) -> tuple[Column, Column, Column]:
    """RGB from hue, the largest and the smallest of the three."""
    span = top - low

    def channel(shift: float) -> Column:
        k = F.pmod(h / 60 + shift, F.lit(6.0))
        return low + span * F.least(F.greatest(F.least(k, F.lit(4.0) - k), F.lit(0.0)), F.lit(1.0))

    return channel(2.0), channel(0.0), channel(4.0)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    return _sextant(h, v, v - v * s)


def hls_to_rgb(h: Column, l_: Column, s: Column) -> tuple[Column, Column, Column]:
    half = F.when(l_ < 0.5, l_ * s).otherwise(s - l_ * s)
    return _sextant(h, l_ + half, l_ - half)


def difference_index(pos: Column, neg: Column) -> Column:
    """(pos - neg) / (pos + neg), 0 where the sum is 0: NDVI, NDWI and their kin."""
    total = (pos + neg).cast("double")
    return F.when(total == 0, 0.0).otherwise(F.try_divide((pos - neg).cast("double"), total))


def build_up(red: Column, nir: Column, swir: Column) -> Column:
    """Built-up index NDBI - NDVI, halved into [-1, 1]."""
    return (difference_index(swir, nir) - difference_index(nir, red)) / 2


#: Tasselled-cap coefficients (brightness, greenness, wetness).
#: Landsat bands: blue, green, red, nir, swir1, swir2.
LANDSAT_CAP = (
    (0.3037, 0.2793, 0.4743, 0.5585, 0.5082, 0.1863),
    (-0.2848, -0.2435, -0.5436, 0.7243, 0.0840, -0.1800),
    (0.1509, 0.1973, 0.3279, 0.3406, -0.7112, -0.4572),
)
#: MODIS bands: red, nir, blue, green, swir3, swir1, swir2.
MODIS_CAP = (
    (0.4395, 0.5945, 0.2460, 0.3918, 0.3506, 0.2136, 0.2678),
    (-0.4064, 0.5129, -0.2744, -0.2893, 0.4882, -0.0036, -0.4169),
    (0.1147, 0.2489, 0.2408, 0.3132, -0.3122, -0.6416, -0.5087),
)


def tasselled_cap(bands: list[Column], sensor: str, scale: float | None = None) -> tuple[Column, ...]:
    """Brightness, greenness, wetness; ``scale`` divides them (2.3103 and 2.6206 fit a type's range)."""
    m = {"landsat": LANDSAT_CAP, "modis": MODIS_CAP}[sensor]
    if len(bands) != len(m[0]):
        raise SizeError(f"{sensor} needs {len(m[0])} bands, not {len(bands)}")
    out = []
    for row in m:
        total = bands[0] * row[0]
        for b, c in zip(bands[1:], row[1:], strict=True):
            total = total + b * c
        out.append(total if scale is None else total / scale)
    return tuple(out)
