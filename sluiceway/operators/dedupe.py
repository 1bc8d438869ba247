"""Keeping one row per key.

`row_number() = 1` is planned with a group limit before the shuffle, so each task sends at most
one row per key: a hot key costs one row per task, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.ordering import asc


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`. Make the order total: end it with a unique column."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def keep_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key where nothing says which: the smallest by all other columns."""
    rest = [c for c in df.columns if c not in set(keys)]
    return keep_first(df, keys, [asc(c) for c in rest] or [F.lit(1)])


def collapse_copies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Identical rows once; combined before the shuffle."""
    return (df.select(*columns) if columns else df).distinct()
