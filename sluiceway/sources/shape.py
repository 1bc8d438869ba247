"""Turning semi-structured rows into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sheet_table(rows: DataFrame, header: Sequence[str], cells: str = "cells", row_number: str = "row_number") -> DataFrame:
    """A sheet tab as a table: cell i under the i-th header name. Short rows lack their last columns (NULL),
    and cells beyond the header are dropped. The header row itself is row 1."""
    body = rows.where(F.col(row_number) > 1)
    return body.select(*[F.try_element_at(F.col(cells), F.lit(i)).alias(name) for i, name in enumerate(header, 1)])


def sheet_header(rows: DataFrame, cells: str = "cells", row_number: str = "row_number") -> list[str]:
    first = rows.where(F.col(row_number) == 1).select(cells).first()
    return list(first[0]) if first else []


def _flat(schema: T.StructType, parent: Column | None = None, prefix: str = "") -> list[Column]:
    out = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`") if parent is None else parent.getField(field.name)
        name = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += _flat(field.dataType, column, f"{name}__")
        elif not isinstance(field.dataType, T.ArrayType):
            out.append(column.alias(name))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as `parent__child` columns; lists are left to `child_table`."""
    return df.select(*_flat(df.schema))


def child_table(df: DataFrame, key: str, path: str) -> DataFrame:
    """One row per element of a list: the parent's key, the position from 0, and the element's columns.

    A parent without elements has no row.
    """
    element = "_element"
    rows = df.select(F.col(key).alias("_parent_id"), F.posexplode(F.col(path)).alias("_position", element))
    kind = rows.schema[element].dataType
    if isinstance(kind, T.StructType):
        return rows.select("_parent_id", "_position", *_flat(kind, F.col(element)))
    return rows.withColumnRenamed(element, "value")
