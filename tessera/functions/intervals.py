"""Intervals, sets of them, their grammar and their predicates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument

INF = math.inf
_ONE = re.compile(r"\s*([\[\(]?)\s*([+-]?(?:inf|[\d.]+(?:e[+-]?\d+)?))\s*(?:[,\s]\s*([+-]?(?:inf|[\d.]+(?:e[+-]?\d+)?)))?\s*([\]\)]?)\s*", re.I)


@dataclass(frozen=True, order=True)
class Interval:
    low: float
    high: float
    low_closed: bool = True
    high_closed: bool = True

    @staticmethod
    def parse(text: str) -> Interval:
        """``[a,b]`` closed, ``(a,b)`` or ``a,b`` open, mixes of both, or a number."""
        m = _ONE.fullmatch(text)
        if not m:
            raise InvalidArgument(f"not an interval: {text!r}")
        left, a, b, right = m.groups()
        low, high = float(a), float(b if b is not None else a)
        single = b is None
        if low > high:
            raise InvalidArgument(f"empty interval: {text!r}")
        return Interval(low, high, (left == "[" or (single and not left)) and not math.isinf(low), (right == "]" or (single and not right)) and not math.isinf(high))

    @property
    def empty(self) -> bool:
        return self.low > self.high or (self.low == self.high and not (self.low_closed and self.high_closed))

    def discrete(self) -> Interval:
        """For integers: open bounds become closed ones, one further in."""
        low = self.low if math.isinf(self.low) else (math.floor(self.low) + 1 if not self.low_closed else math.ceil(self.low))
        high = self.high if math.isinf(self.high) else (math.ceil(self.high) - 1 if not self.high_closed else math.floor(self.high))
        return Interval(max(low, -(2**31)), min(high, 2**31 - 1))

    def contains(self, value: Column, strict: bool = False) -> Column:
        """Open float bounds count as closed unless ``strict``; NaN is in no interval."""
        low = value > self.low if strict and not self.low_closed else value >= self.low
        high = value < self.high if strict and not self.high_closed else value <= self.high
        test = F.lit(True)
        if not math.isinf(self.low):
            test = test & low
        if not math.isinf(self.high):
            test = test & high
        return test & value.isNotNull() & ~F.isnan(value.cast("double"))


def _edge(i: Interval, upper: bool) -> tuple[float, int]:
    """Bounds as points on a line where an open one lies just inside."""
    return (i.high, 0 if i.high_closed else -1) if upper else (i.low, 0 if i.low_closed else 1)


@dataclass(frozen=True)
class IntervalSet:
    parts: tuple[Interval, ...] = ()

    @staticmethod
    def parse(text: str) -> IntervalSet:
        found = re.findall(r"[\[\(][^\[\]\(\)]*[\]\)]|[^\s,\[\]\(\)]+", text)
        if not found:
            raise InvalidArgument(f"no interval in {text!r}")
        return IntervalSet(tuple(map(Interval.parse, found))).normal()

    @staticmethod
    def everything() -> IntervalSet:
        return IntervalSet((Interval(-INF, INF, False, False),))

    def normal(self) -> IntervalSet:
        """Sorted, without empty parts, touching ones merged."""
        out: list[Interval] = []
        for i in sorted((p for p in self.parts if not p.empty), key=lambda p: (_edge(p, False), _edge(p, True))):
            if out and (i.low < out[-1].high or (i.low == out[-1].high and (i.low_closed or out[-1].high_closed))):
                last = out.pop()
                far = max(last, i, key=lambda p: _edge(p, True))
                i = Interval(last.low, far.high, last.low_closed, far.high_closed)
            out.append(i)
        return IntervalSet(tuple(out))

    def __or__(self, other: IntervalSet) -> IntervalSet:
        return IntervalSet(self.parts + other.parts).normal()

    def __sub__(self, other: IntervalSet) -> IntervalSet:
        left = list(self.normal().parts)
        for cut in other.normal().parts:
            left = [p for i in left for p in _cut(i, cut)]
        return IntervalSet(tuple(left)).normal()

    def __and__(self, other: IntervalSet) -> IntervalSet:
        return self - (IntervalSet.everything() - other)

    def discrete(self) -> IntervalSet:
        return IntervalSet(tuple(p.discrete() for p in self.parts)).normal()

    def contains(self, value: Column, strict: bool = False) -> Column:
        return reduce(lambda a, b: a | b, (p.contains(value, strict) for p in self.parts), F.lit(False))


def _cut(i: Interval, cut: Interval) -> list[Interval]:
    """What is left of i outside cut."""
    out = []
    if i.low <= cut.low:
        closed = (i.high_closed if i.high < cut.low else not cut.low_closed if i.high > cut.low else i.high_closed and not cut.low_closed)
        out.append(Interval(i.low, min(i.high, cut.low), i.low_closed, closed))
    if i.high >= cut.high:
        closed = (i.low_closed if i.low > cut.high else not cut.high_closed if i.low < cut.high else i.low_closed and not cut.high_closed)
        out.append(Interval(max(i.low, cut.high), i.high, closed, i.high_closed))
    return [p for p in out if not p.empty]


def ordered_set(steps: list[tuple[str, IntervalSet]]) -> IntervalSet:
    """Apply 'valid' and 'invalid' ranges in order; a first 'invalid' starts from everything."""
    out = IntervalSet.everything() if steps and steps[0][0] == "invalid" else IntervalSet()
    for kind, part in steps:
        if kind not in ("valid", "invalid"):
            raise InvalidArgument(f"neither valid nor invalid: {kind!r}")
        out = out | part if kind == "valid" else out - part
    return out
