"""Places within groups of any size: rows are sorted once over all groups and numbered in ranges side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import partitions, stored
from sluiceway.skew import stored_side

# Spark's increasing ids hold the partition above this many bits.
ID_BITS = 33


def numbered(rows: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """`rows` with `pos`, the place within `group` counted from 0, and `n`, the group's size.

    `group` is a column without nulls; ties in `order` are broken by the place in the table. `rows` should be a stored
    table, since it is read twice (once to find the ranges). A hot group is cut into as many ranges as it fills, and
    only the ranges' counts are summed by group."""
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(partitions(rows.sparkSession), group, *order, "__tie").sortWithinPartitions(group, *order, "__tie")
    placed = stored(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("__range", F.shiftright("__at", ID_BITS))
    sizes = placed.groupBy(group, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, "__range", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__size").over(whole).alias("n"))
    joined = placed.join(stored_side(offsets, f"{label}-offsets"), [group, "__range"])
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n")
