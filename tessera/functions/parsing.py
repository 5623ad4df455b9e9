"""Arguments as text: numbers, angles, places, sizes, rectangles, images and masks.

Arguments are words; a word's parts in parentheses or quotes keep their blanks.  An
image argument is a list of ``-f`` file, ``-d`` date, ``-t`` tag, ``-b`` bands, ``-c``
crop and the flag ``--disable-use-color-table``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import InvalidArgument
from tessera.functions.geo import Rectangle
from tessera.model import TYPES

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = re.compile(rf"^\(?\s*({_NUMBER})\s*[x,\s]\s*({_NUMBER})\s*\)?$")
_PART = re.compile(rf"^\s*({_NUMBER})\s*(°|deg|d|'|min|m|\"|sec|s)?")
#: How many of a part make a degree, and the sign of a hemisphere.
_DEGREES = {None: 1, "°": 1, "d": 1, "deg": 1, "'": 60, "m": 60, "min": 60, '"': 3600, "s": 3600, "sec": 3600}
_SIGN = {"N": 1, "E": 1, "S": -1, "W": -1}


def integer(text: str) -> int:
    try:
        return int(text.strip())
    except ValueError:
        raise InvalidArgument(f"not a whole number: {text!r}") from None


def number(text: str) -> float:
    try:
        return float(text.strip())
    except ValueError:
        raise InvalidArgument(f"not a number: {text!r}") from None


def base_type(text: str) -> str:
    name = text.strip().lower()
    if name not in TYPES:
        raise InvalidArgument(f"no such type: {text!r}")
    return name


def angle(text: str) -> float:
    """Degrees, minutes and seconds, with a sign or a hemisphere: 12.5, -3 30', 48° 12' 9" N."""
    rest, sign = text.strip(), 1
    if rest and rest[-1].upper() in _SIGN:
        sign, rest = _SIGN[rest[-1].upper()], rest[:-1]
    elif rest and rest[0].upper() in _SIGN:
        sign, rest = _SIGN[rest[0].upper()], rest[1:]
    rest = rest.strip()
    if rest.startswith("-"):
        sign, rest = -sign, rest[1:]
    total, place, order = 0.0, 0, (1, 60, 3600)
    if not rest:
        raise InvalidArgument(f"not an angle: {text!r}")
    while rest.strip():
        found = _PART.match(rest)
        if not found or found[1].startswith(("-", "+")) or place == len(order):
            raise InvalidArgument(f"not an angle: {text!r}")
        unit = order[place] if found[2] is None else _DEGREES[found[2]]
        if unit not in order[place:] or (unit > 1 and float(found[1]) >= 60):
            raise InvalidArgument(f"not an angle: {text!r}")
        total += float(found[1]) / unit
        place, rest = order.index(unit) + 1, rest[found.end() :]
    return sign * total


def geo_coordinate(text: str) -> tuple[float, float]:
    """(latitude, longitude) in degrees: two angles, hemispheres in either order, else latitude first."""
    body = text.strip().strip("()")
    cut = re.match(r"^(.*?[NSEW])\s*[,;]?\s*(.+)$", body, re.I) if re.search(r"[NSEW]\s*[,;\s]", body, re.I) else re.match(r"^([^,;]+)[,;](.+)$", body) or re.match(r"^(\S+)\s+(\S+)$", body)
    if not cut:
        raise InvalidArgument(f"not two angles: {text!r}")
    parts = [(angle(p), next((c.upper() for c in p if c.upper() in _SIGN), "")) for p in cut.groups()]
    if parts[0][1] in ("E", "W") or parts[1][1] in ("N", "S"):
        parts.reverse()
    if parts[0][1] in ("E", "W") or parts[1][1] in ("N", "S"):
        raise InvalidArgument(f"not a latitude and a longitude: {text!r}")
    (latitude, _), (longitude, _) = parts
    if abs(latitude) > 90 or abs(longitude) > 360:
        raise InvalidArgument(f"no such place: {text!r}")
    return latitude, longitude


def coordinate(text: str) -> tuple[float, float]:
    """x and y: (1.5, 2), 1.5 2."""
    found = _PAIR.match(text.strip())
    if not found:
        raise InvalidArgument(f"not two numbers: {text!r}")
    return float(found[1]), float(found[2])


def point(text: str) -> tuple[int, int]:
    x, y = coordinate(text)
    if x != int(x) or y != int(y):
        raise InvalidArgument(f"not whole numbers: {text!r}")
    return int(x), int(y)


def size(text: str) -> tuple[int, int]:
    """Width and height: 30x20, (30, 20)."""
    w, h = point(text)
    if w < 0 or h < 0:
        raise InvalidArgument(f"no such size: {text!r}")
    return w, h


def rectangle(text: str, whole: bool = True) -> Rectangle:
    """``-x=1 -y=2 -w=3 -h=4``, ``-x=(1, 3)`` for a range with both ends, ``-center`` with sides, or ``(x, y, w, h)``."""
    convert = point if whole else coordinate
    flat = re.match(rf"^\(?\s*({_NUMBER})\s*,\s*({_NUMBER})\s*,\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\)?$", text.strip())
    if flat:
        values = [float(v) for v in flat.groups()]
    else:
        given: dict[str, str] = {}
        for word in words(text):
            found = re.match(r"^--?(x|y|w|h|width|height|center)=(.+)$", word)
            if not found or found[1][0] in given:
                raise InvalidArgument(f"not a rectangle: {text!r}")
            given[found[1][0] if found[1] != "center" else "center"] = found[2]
        center = convert(given["center"]) if "center" in given else None
        values = []
        for axis, side, middle in (("x", "w", 0), ("y", "h", 1)):
            length = number(given[side]) if side in given else None
            if center is not None:
                if axis in given or length is None:
                    raise InvalidArgument(f"a centre needs both sides and no corner: {text!r}")
                start = center[middle] - (length // 2 if whole else length / 2)
            elif axis not in given:
                raise InvalidArgument(f"no {axis} in {text!r}")
            elif _PAIR.match(given[axis]):
                if length is not None:
                    raise InvalidArgument(f"two lengths for {axis}: {text!r}")
                start, end = convert(given[axis])
                length = end - start + (1 if whole else 0)
            else:
                start = number(given[axis])
            values += [start, 0 if length is None else length]
        values = [values[0], values[2], values[1], values[3]]
    if min(values[2:]) < 0 or (whole and any(v != int(v) for v in values)):
        raise InvalidArgument(f"not a rectangle: {text!r}")
    return Rectangle(*(int(v) if whole else v for v in values))


def words(text: str) -> list[str]:
    """Words of a line; quotes and parentheses, which may be nested, keep blanks inside, and outer quotes go."""
    out, now, depth, quote = [], "", 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
            now += "" if not quote and not depth else c
        elif c in "'\"" and not (now and now[-1].isdigit()):
            quote = c
            now += c if depth else ""
        elif c.isspace() and not depth:
            if now:
                out.append(now)
            now = ""
        else:
            depth += (c == "(") - (c == ")")
            now += c
        if depth < 0:
            raise InvalidArgument(f"a parenthesis too many: {text!r}")
    if depth or quote:
        raise InvalidArgument(f"a parenthesis or quote isn't closed: {text!r}")
    return [*out, now] if now else out


@dataclass(frozen=True)
class ImageArgument:
    """One image as named by its arguments."""

    file: str
    date: int | None = None
    tag: str | None = None
    bands: tuple[int, ...] = ()
    crop: Rectangle | None = None
    use_color_table: bool = True

    @classmethod
    def parse(cls, text: str) -> ImageArgument:
        given: dict = {}
        rest = words(text)
        while rest:
            word = rest.pop(0)
            if word == "--disable-use-color-table":
                given["use_color_table"] = False
                continue
            found = re.match(r"^--?(f|file|d|date|t|tag|b|bands|c|crop)(?:=(.*))?$", word, re.S)
            if not found:
                if "file" in given:
                    raise InvalidArgument(f"what is {word!r}?")
                given["file"] = word
                continue
            value = found[2] if found[2] is not None else (rest.pop(0) if rest else "")
            name = {"f": "file", "d": "date", "t": "tag", "b": "bands", "c": "crop"}[found[1][0]]
            if name in given or value == "":
                raise InvalidArgument(f"{name} is given twice or without a value")
            plain = value.strip()[1:-1] if value.strip().startswith("(") else value
            given[name] = {"date": integer, "bands": lambda v: tuple(integer(x) for x in re.split(r"[\s,]+", v.strip())), "crop": rectangle}.get(name, str)(value if name == "crop" and re.match(r"^\([^-]*\)$", value) else plain)
        if not given.get("file"):
            raise InvalidArgument("no file is named")
        return cls(**given)

    def named(self, date: bool = True, tag: bool = True) -> ImageArgument:
        """Itself, if it has what an image of a job needs."""
        if (date and self.date is None) or (tag and not self.tag):
            raise InvalidArgument(f"{self.file} needs a date and a tag")
        return self
