"""How source types are stored in bronze files, and how they come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BronzeError(Exception):
    """A batch cannot be extracted, trusted or loaded."""


def stored_type(kind: T.DataType) -> T.DataType:
    """Integers widen, decimals and JSON variants become exact text; what would be lossy is refused."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return kind
    if isinstance(kind, (T.StringType, T.DecimalType, T.VariantType)):
        return T.StringType()
    raise BronzeError(f"column type {kind.simpleString()!r} is not supported; refusing a lossy form")


def stored_columns(schema: T.StructType) -> list[Column]:
    out = []
    for field in schema.fields:
        column, target = F.col(f"`{field.name}`"), stored_type(field.dataType)
        if isinstance(field.dataType, T.VariantType):
            column = F.to_json(column)
        out.append(column.cast(target).alias(field.name))
    return out


def typed_columns(schema: T.StructType) -> list[Column]:
    """Stored columns back in their source types."""
    out = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.VariantType):
            column = F.parse_json(column)
        else:
            column = column.cast(field.dataType)
        out.append(column.alias(field.name))
    return out


def stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, stored_type(f.dataType)) for f in schema.fields])
