"""Bounded as-of lookup: the latest value on or up to N days before a date.

The lookup side is spread over the days each value stays usable and reduced to one value per key
and day, stored and measured. The large side then needs a single equi-join, without a shuffle while
the values fit a broadcast: no range condition, no regrouping, and its rows do not multiply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.skew import stored_side


def usable_by_day(
    values: DataFrame, keys: Sequence[str], day: str, value: str, lookback_days: int
) -> DataFrame:
    """One row per key and day: the latest non-NULL value at most `lookback_days` old.

    A row without a value counts as no row, so the lookup goes on to older days. Two values for
    one key and day are resolved to the larger; gate (keys, day) as unique to rule that out.
    """
    spread = values.where(F.col(value).isNotNull() & F.col(day).isNotNull()).select(
        *keys,
        F.col(day).alias("_from"),
        F.col(value).alias("_value"),
        F.explode(F.sequence(F.col(day), F.date_add(F.col(day), lookback_days))).alias("_day"),
    )
    latest = F.max(F.struct("_from", "_value"))
    return spread.groupBy(*keys, "_day").agg(latest.alias("_latest")).select(
        *keys, "_day", F.col("_latest._value").alias(value), F.col("_latest._from").alias(f"{value}_date")
    )


def with_asof(
    facts: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    fact_day: str,
    value_day: str,
    value: str,
    lookback_days: int,
) -> DataFrame:
    """`facts` with the looked-up `value` (NULL when none is recent enough) and its date."""
    calendar = usable_by_day(values, keys, value_day, value, lookback_days)
    side = stored_side(calendar, "asof").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col(fact_day).cast("date") == F.col("_day")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return facts.join(side, same, "left").drop("_day", *[f"_{k}" for k in keys])
