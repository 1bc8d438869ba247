"""Tables from literal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluiceway.operators.compare import expected_frame


def literal_table(spark: SparkSession, columns: Mapping[str, str], rows: Sequence[Mapping]) -> DataFrame:
    """Rows in declared types. A row may leave columns out (NULL) but not name an undeclared one."""
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(t)) for c, t in columns.items()])
    for i, row in enumerate(rows):
        undeclared = sorted(set(row) - set(columns))
        if undeclared:
            raise ValueError(f"row {i} names undeclared column(s) {undeclared}")
    return expected_frame(spark, [{c: row.get(c) for c in columns} for row in rows], schema)


def literal_tables(spark: SparkSession, spec: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Several tables from `{name, columns, rows}` mappings."""
    names = [t["name"] for t in spec]
    if len(set(names)) != len(names):
        raise ValueError(f"a table is declared twice: {sorted(names)}")
    return {t["name"]: literal_table(spark, t["columns"], t.get("rows") or []) for t in spec}
