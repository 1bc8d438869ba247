"""Exact arithmetic helpers; all rounding is half up on decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str, precision: int = 20, scale: int = 2) -> Column:
    return _col(c).cast(f"decimal({precision},{scale})")


def with_rate(amount: Column | str, rate: str | Decimal, scale: int = 2) -> Column:
    """amount * rate, rounded half up."""
    return F.round(_col(amount) * F.lit(Decimal(rate)), scale)


def percentage(part: Column, whole: Column, scale: int = 1) -> Column:
    """100 * part / whole as decimal(5, scale); `whole` must not be zero."""
    exact = F.lit(Decimal("100.0")) * part.cast("decimal(18,0)") / whole.cast("decimal(18,0)")
    return F.round(exact, scale).cast(f"decimal({4 + scale},{scale})")


def duration(start: Column | str, end: Column | str, precision: int = 20, scale: int = 6) -> Column:
    """end - start, subtracted as decimals."""
    kind = f"decimal({precision},{scale})"
    return _col(end).cast(kind) - _col(start).cast(kind)


def integral_text(c: Column | str) -> Column:
    """Text of a double, without a fraction when it has none: 12.0 gives '12'."""
    value = _col(c)
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))
