"""Incremental reads and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.ordering import asc, desc
from sluiceway.operators.dedupe import keep_first
from sluiceway.skew import stored_side


def past_cursor(df: DataFrame, cursor: str, last) -> DataFrame:
    """Rows at or past the stored cursor (a value or a literal column). Equal ones are read again; the merge absorbs
    them. Rows without a cursor value are kept too, so that whoever lands them sees them."""
    if last is None:
        return df
    return df.where((F.col(cursor) >= (last if isinstance(last, Column) else F.lit(last))) | F.col(cursor).isNull())


def latest_versions(delta: DataFrame, keys: Sequence[str], cursor: str) -> DataFrame:
    """The newest row of each key by the cursor."""
    return _newest(delta, keys, cursor)


def _newest(rows: DataFrame, keys: Sequence[str], cursor: str, load: str | None = None) -> DataFrame:
    rest = [asc(c) for c in rows.columns if c not in {*keys, cursor, load}]
    return keep_first(rows, keys, [desc(cursor), *([desc(load)] if load else []), *rest])


DIGEST = "__digest"


def with_digest(rows: DataFrame) -> DataFrame:
    """`rows` with 64 bits over all their columns. Maps are taken by their sorted entries."""
    parts = [
        F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in rows.schema.fields
    ]
    return rows.withColumn(DIGEST, F.xxhash64(*parts))


def not_seen(rows: DataFrame, seen: DataFrame, keys: Sequence[str], cursor: str) -> DataFrame:
    """Rows with a digest that are not among `seen`, which holds keys, cursor and digest of rows that have landed.

    A digest only has to tell versions of one key with one cursor value apart. Rows without a key or cursor value are kept,
    so that whoever lands them sees them. After a change of column types all rows are new.
    """
    same = [*keys, cursor, DIGEST]
    if any(rows.schema[c].dataType != seen.schema[c].dataType for c in same):
        return rows
    return rows.join(seen.select(*same), same, "left_anti").select(*rows.columns)


def missed_rows(source: DataFrame, landed: DataFrame, keys: Sequence[str], cursor: str, bound: Column) -> DataFrame:
    """Keys and cursors of source rows behind `bound` that `landed` does not reflect: their key never landed, or its
    landed row is older. Reads keys and cursors only; equal source rows count each."""
    behind, known = source.where(F.col(cursor) < bound).select(*keys, cursor).alias("s"), landed.select(*keys, cursor).alias("l")
    newer = F.col(f"l.{cursor}") >= F.col(f"s.{cursor}")
    for k in keys:
        newer = newer & (F.col(f"l.{k}") == F.col(f"s.{k}"))
    return behind.join(known, newer, "left_anti")


LOAD = "__load"


def merge_changes(base: DataFrame, delta: DataFrame, keys: Sequence[str], cursor: str) -> DataFrame:
    """`base` with the rows of `delta` inserted or replaced on `keys`; a second run changes nothing.

    The newest row by the cursor wins wherever it lies, and `delta` wins between equal ones. A NULL key is a key like any
    other. Only base rows whose key changed are regrouped; when the changed keys fit a broadcast, the rest of `base` is
    filtered in place and never shuffled.
    """
    changed = stored_side(delta.select(*keys).distinct(), "changed-keys").alias("c")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
    known = base.alias("b")
    touched = known.join(changed, same, "left_semi").withColumn(LOAD, F.lit(0))
    newest = _newest(touched.unionByName(delta.withColumn(LOAD, F.lit(1))), keys, cursor, LOAD).drop(LOAD)
    return known.join(changed, same, "left_anti").select(*base.columns).unionByName(newest.select(*base.columns))
