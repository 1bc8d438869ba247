"""Position of every row in its group, also for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway import skew
from sluiceway.session import cut_lineage


def position_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    rows_per_task: int = skew.ROWS_PER_TASK,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """`row_number()` over `group` in `order`, counted from 1. The order should be total.

    `sized_by` may name a cheaper table to count groups in, such as the one `df` was joined from.

    Ordinary groups use a window. Groups above `rows_per_task` are cut into sorted ranges that
    many tasks number side by side; a short table of range offsets then shifts each range.
    """
    hot = skew.hot_groups(df if sized_by is None else sized_by, group, rows_per_task)
    if hot is None:
        return _by_window(df, group, order, name)
    cold, large = skew.split_hot(df, group, hot)
    return _by_window(cold, group, order, name).unionByName(_by_range(large, group, order, name))


def _by_window(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def _by_range(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    # Written to shared storage before and after the range shuffle: the ids that spread exact ties
    # and the range numbers must not change when a lost task runs again.
    stored = cut_lineage(df, "rank-in").withColumn("_tie", F.monotonically_increasing_id())
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        stored.repartitionByRange(ranges, *group, *order, "_tie").withColumn("_range", F.spark_partition_id()),
        "rank-ranges",
    )
    # Rows of one group lie in neighbouring ranges: at most groups + ranges rows here.
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order, "_tie"))
    )
    same = F.col("l._range") == F.col("o._range")
    for k in group:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = local.alias("l").join(skew.stored_side(offsets, "rank-offsets").alias("o"), same)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.col("o._offset")).cast("bigint").alias(name),
    )
