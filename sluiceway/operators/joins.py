"""Joins on cleaned or cast keys.

No side is broadcast here by hand except a lookup whose size was checked; for everything else the
planner decides from statistics, and adaptive execution splits hot partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.skew import broadcast_if_small


def inner_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def inner_on_clean(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Inner join on expressions, each computed once as a column so the join is a plain equi-join."""
    a = left.withColumn("_key", left_key)
    b = right.withColumn("_key", right_key)
    return a.join(b, "_key", "inner").drop("_key")


def enrich(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, columns: Sequence[str]) -> DataFrame:
    """All left rows with `columns` of the matching right rows, NULL where there is none."""
    side = right.select(right_key.alias("_right_key"), *columns)
    return (
        left.withColumn("_left_key", left_key)
        .join(side, F.col("_left_key") == F.col("_right_key"), "left")
        .drop("_left_key", "_right_key")
    )


def having_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows with at least one match (EXISTS)."""
    side = right.select(F.col(right_key).alias("_k"))
    return left.join(side, F.col(left_key) == F.col("_k"), "left_semi")


def lacking_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows without a match (NOT EXISTS); a NULL key has no match and stays."""
    side = right.select(F.col(right_key).alias("_k"))
    return left.join(side, F.col(left_key) == F.col("_k"), "left_anti")


def without_listed(left: DataFrame, listed: DataFrame, left_key: Column, listed_key: str) -> DataFrame:
    """Left rows whose key is not on an exclusion list; the list is broadcast if it is small."""
    side = broadcast_if_small(listed.select(F.col(listed_key).alias("_k")).where("_k is not null").distinct())
    return left.withColumn("_key", left_key).join(side, F.col("_key") == F.col("_k"), "left_anti").drop("_key")
