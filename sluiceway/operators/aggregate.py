"""Grouped and global aggregates, and ordered concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway import skew
from sluiceway.functions.dates import month_key
from sluiceway.operators.ranking import position_in_group

# An ordered concatenation sorts a whole group inside one task; larger groups go in pieces.
CONCAT_ROWS = 50_000


def by_month(df: DataFrame, moment: str, *measures: Column) -> DataFrame:
    """Measures by month 'YYYY-MM'. Rows group on the month's first day; only finished groups are formatted."""
    groups = df.groupBy(F.trunc(moment, "month").alias("_month")).agg(*measures)
    return groups.withColumn("_month", month_key("_month")).withColumnRenamed("_month", "month")


def first_event(df: DataFrame, key: str, moment: str, name: str) -> DataFrame:
    """Earliest moment per key; rows without key or moment do not count."""
    usable = df.where(F.col(key).isNotNull() & F.col(moment).isNotNull())
    return usable.groupBy(key).agg(F.min(moment).alias(name))


def mixed_values(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one distinct value: min differs from max, so no distinct set is kept."""
    spread = df.groupBy(key).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return spread.where(F.col("_low") != F.col("_high")).select(key)


def one_row_summary(df: DataFrame, counted: str, distinct: str, bounded: Column, names: Sequence[str]) -> DataFrame:
    """Row count, distinct count, minimum and maximum as one row. `counted` is '*' or a column."""
    rows = F.count(F.lit(1)) if counted == "*" else F.count_distinct(F.col(counted))
    return df.agg(
        rows.alias(names[0]),
        F.count_distinct(F.col(distinct)).alias(names[1]),
        F.min(bounded).alias(names[2]),
        F.max(bounded).alias(names[3]),
    )


def ordered_concat(
    df: DataFrame,
    group: Sequence[str],
    value: Column,
    order: Sequence[str],
    name: str,
    separator: str = ",",
    rows_per_task: int = CONCAT_ROWS,
) -> DataFrame:
    """The text forms of `value` per group, in ascending `order`, joined by `separator`.

    NULL values are left out. Groups above `rows_per_task` are numbered, joined in pieces by many
    tasks, and the pieces joined last, so only the finished text of such a group meets in a task.
    """
    rows = df.select(*group, *order, value.cast("string").alias("_text")).where("_text is not null")
    hot = skew.hot_groups(rows, group, rows_per_task)
    if hot is None:
        return _concat(rows, group, order, separator, name)
    ordinary, hot_rows = skew.split_hot(rows, group, hot)
    cold = _concat(ordinary, group, order, separator, name)
    large = position_in_group(hot_rows, group, [F.asc(c) for c in order], "_pos", rows_per_task).withColumn(
        "_piece", F.floor((F.col("_pos") - 1) / rows_per_task)
    )
    pieces = _concat(large, [*group, "_piece"], ["_pos"], separator, "_text")
    return cold.unionByName(_concat(pieces, group, ["_piece"], separator, name))


def _concat(rows: DataFrame, group: Sequence[str], order: Sequence[str], separator: str, name: str) -> DataFrame:
    collected = F.sort_array(F.collect_list(F.struct(*order, "_text")))
    texts = F.transform(collected, lambda s: s["_text"])
    return rows.groupBy(*group).agg(F.array_join(texts, separator).alias(name))


def json_documents(df: DataFrame, group: Sequence[str], fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """All rows of a group as one JSON array of objects, in `order`."""
    rows = df.withColumn("_doc", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    parts = ordered_concat(rows, group, F.col("_doc"), order, name)
    return parts.withColumn(name, F.concat(F.lit("["), F.col(name), F.lit("]")))
