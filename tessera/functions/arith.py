"""Cell arithmetic with the saturating semantics of image types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.model import base_type, saturate


def add(a: Column, b: Column, dtype: str) -> Column:
    return saturate(a + b, dtype)


def subtract(a: Column, b: Column, dtype: str) -> Column:
    return saturate(a - b, dtype)


def multiply(a: Column, b: Column, dtype: str) -> Column:
    return saturate(a * b, dtype)


def divide(a: Column, b: Column | float, dtype: str) -> Column:
    """Integer images: x / 0 is 0 and quotients round half to even; a constant 0 is an error."""
    if not isinstance(b, Column):
        if b == 0:
            raise InvalidArgument("division by the constant 0")
        b = F.lit(float(b))
    a, b = a.cast("double"), b.cast("double")
    if base_type(dtype).integral:
        return saturate(F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b)), dtype)
    sign = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, sign).otherwise(F.try_divide(a, b))


def absolute(a: Column, dtype: str) -> Column:
    return saturate(F.abs(a), dtype)


def absdiff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def minimum(a: Column, b: Column, mask: Column | None = None) -> Column:
    """Only where the mask holds; elsewhere a stays."""
    return F.least(a, b) if mask is None else F.when(mask, F.least(a, b)).otherwise(a)


def maximum(a: Column, b: Column, mask: Column | None = None) -> Column:
    return F.greatest(a, b) if mask is None else F.when(mask, F.greatest(a, b)).otherwise(a)


def bitwise(op: str, a: Column, b: Column | None = None) -> Column:
    """'and', 'or', 'xor' and 'not'; a missing operand is the identity."""
    if op == "not":
        return F.bitwise_not(a)
    if b is None:
        return a
    return {"and": a.bitwiseAND, "or": a.bitwiseOR, "xor": a.bitwiseXOR}[op](b)


def put(a: Column, value: Column | float, mask: Column | None = None) -> Column:
    """Overwrite where the mask holds."""
    value = value if isinstance(value, Column) else F.lit(value)
    return value if mask is None else F.when(mask, value).otherwise(a)


def convert(a: Column, dtype: str) -> Column:
    return saturate(a.cast("double"), dtype)
