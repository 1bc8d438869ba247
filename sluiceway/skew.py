"""Measures against hot keys: checked broadcasts, and the list of groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluiceway.session import scratch_path

# A broadcast side has at most this many rows and this many bytes of JSON text.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

# A group is hot when it has more rows than one task should sort.
ROWS_PER_TASK = 2_000_000


def _size() -> list[Column]:
    json_bytes = F.octet_length(F.to_json(F.struct("*")))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(json_bytes), F.lit(0)).alias("b")]


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` fits a broadcast, by counting at most `max_rows + 1` of its rows."""
    probe = df.limit(max_rows + 1).agg(*_size()).first()
    return probe["n"] <= max_rows and probe["b"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its size was checked, else unchanged: the join then shuffles
    and adaptive execution splits hot partitions."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def stored_side(
    df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """A join side written to shared scratch and measured by the same job, with a broadcast hint if small."""
    return _store(df, label, max_rows, max_bytes)[0]


def _store(df: DataFrame, label: str, max_rows: int, max_bytes: int) -> tuple[DataFrame, int]:
    # A task that runs twice may be measured twice, which can only lead to the join by shuffle.
    path, size = scratch_path(df.sparkSession, label), Observation()
    df.observe(size, *_size()).write.parquet(path)
    stored, seen = df.sparkSession.read.schema(df.schema).parquet(path), size.get
    small = seen["n"] <= max_rows and seen["b"] <= max_bytes
    return (F.broadcast(stored) if small else stored), seen["n"]


def hot_groups(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK, max_rows: int = BROADCAST_ROWS
) -> DataFrame | None:
    """The keys of all groups too large for one task, as a measured join side; None when there are none.

    One narrow aggregate over the key columns, combined before its shuffle. The list is never
    shortened: should it be too long to broadcast, it is joined by shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    listed, rows = _store(counts.where(F.col("_n") > rows_per_task).select(*keys), "hot-groups", max_rows, BROADCAST_BYTES)
    return listed if rows else None


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups and rows of hot ones; a NULL key is a key like any other."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}"))
    left, right = df.alias("l"), hot.alias("h")
    return left.join(right, same, "left_anti"), left.join(right, same, "left_semi")
