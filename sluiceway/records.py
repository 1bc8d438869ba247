"""Small append-only record sets: a few rows per file, written and read with a fixed schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_made: set[str] = set()


def small_frame(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """Driver-made rows as a DataFrame that needs no Python worker; columns a row leaves out are NULL."""
    struct = T.StructType.fromDDL(schema)
    full = [{name: row.get(name) for name in struct.names} for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(full), struct) if full else spark.createDataFrame([], struct)


def append_records(spark: SparkSession, path: str, rows: Sequence[Mapping], schema: str) -> None:
    """One file, committed whole: readers see all of these rows or none."""
    small_frame(spark, rows, schema).coalesce(1).write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records; the folder is made if nothing was ever appended."""
    if path not in _made:
        spark.createDataFrame([], schema).write.mode("ignore").json(path)
        _made.add(path)
    return spark.read.schema(schema).json(path)
