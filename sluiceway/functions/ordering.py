"""Sort order in which NULL counts as the largest value: last ascending, first descending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(c: Column | str) -> Column:
    return F.asc_nulls_last(c)


def desc(c: Column | str) -> Column:
    return F.desc_nulls_first(c)
