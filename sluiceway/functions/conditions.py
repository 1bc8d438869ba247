"""Predicates and bucket labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions.text import clean


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: Column | str, values: Iterable) -> Column:
    return _col(c).isin(list(values))


def not_in_set(c: Column | str, values: Iterable) -> Column:
    """SQL NOT IN: a NULL value does not pass."""
    return ~_col(c).isin(list(values))


def is_strictly_true(c: Column | str) -> Column:
    """True only; NULL counts as not true."""
    return _col(c).eqNullSafe(F.lit(True))


def is_live(deleted: Column | str) -> Column:
    """Not soft-deleted; a NULL flag means not deleted."""
    return ~F.coalesce(_col(deleted), F.lit(False))


def not_blank(c: Column | str) -> Column:
    return clean(c).isNotNull()


def range_label(c: Column | str, ranges: Iterable[tuple[int | None, int | None, str]]) -> Column:
    """Label of the first inclusive (low, high, label) range holding the value; None is open-ended."""
    value, out = _col(c), None
    for low, high, label in ranges:
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value <= high)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    if out is None:
        raise ValueError("range_label needs at least one range")
    return out
