"""Schemas that grow: the narrowest type that holds two others without losing a value, and tables read under it.

Whole numbers widen by size and into decimals, decimals by their digits before and after the point, a date into a
timestamp, and every plain value into text. Structs, arrays and maps widen inside; a struct keeps the fields of both.
Whatever would lose values (a long into a double) or change its meaning (a timestamp with a zone into one without) has
no common type and is refused by name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits of the largest value.
WHOLE = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
MOST_DIGITS = 38
NESTED = (T.StructType, T.ArrayType, T.MapType)


class TypeConflict(ValueError):
    """Columns whose old and new type have no common type."""


def decimal_of(kind: T.DataType) -> T.DecimalType | None:
    return kind if isinstance(kind, T.DecimalType) else T.DecimalType(WHOLE[kind], 0) if kind in WHOLE else None


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type that holds both, or None."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, NESTED) or isinstance(b, NESTED):
        return common_nested(a, b)
    # Declared lengths are not kept: text is text.
    texts = [isinstance(t, (T.StringType, T.CharType, T.VarcharType)) for t in (a, b)]
    if any(texts):
        other = b if texts[0] else a
        return None if isinstance(other, T.BinaryType) else T.StringType()
    if a in WHOLE and b in WHOLE:
        return max(a, b, key=WHOLE.get)
    x, y = decimal_of(a), decimal_of(b)
    if x and y:
        scale = max(x.scale, y.scale)
        digits = max(x.precision - x.scale, y.precision - y.scale) + scale
        return T.DecimalType(digits, scale) if digits <= MOST_DIGITS else None
    pair = {a, b}
    if T.DoubleType() in pair or T.FloatType() in pair:
        exact = {T.DoubleType(), T.FloatType(), T.ByteType(), T.ShortType(), T.IntegerType()}
        return T.DoubleType() if pair <= exact else None
    if T.DateType() in pair and pair & {T.TimestampType(), T.TimestampNTZType()}:
        return (pair - {T.DateType()}).pop()
    return None


def common_nested(a: T.DataType, b: T.DataType) -> T.DataType | None:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        try:
            return common_schema(a, b)
        except TypeConflict:
            return None
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = common_type(a.elementType, b.elementType)
        return T.ArrayType(inner, True) if inner else None
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        inner = common_type(a.valueType, b.valueType)
        return T.MapType(a.keyType, inner, True) if inner else None
    return None


def common_schema(old: T.StructType, new: T.StructType, keep: Sequence[str] = ()) -> T.StructType:
    """The columns of both, in the old order, under types that hold both; names are equal whatever their case.

    Columns in `keep` may grow but not turn into text, which would order them otherwise."""
    fresh = {f.name.lower(): f for f in new.fields}
    fields, conflicts = [], []
    for field in old.fields:
        other = fresh.pop(field.name.lower(), None)
        kind = field.dataType if other is None else common_type(field.dataType, other.dataType)
        if kind is not None and field.name in keep and kind == T.StringType() != field.dataType:
            kind = None
        if kind is None:
            conflicts.append(f"{field.name}: {field.dataType.simpleString()} and {other.dataType.simpleString()}")
            kind = field.dataType
        fields.append(T.StructField(field.name, kind, True))
    if conflicts:
        raise TypeConflict(f"no common type for {'; '.join(conflicts)}")
    # What is new is nullable: earlier rows have nothing there.
    return T.StructType([*fields, *[T.StructField(f.name, f.dataType, True) for f in fresh.values()]])


def converted(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        known = {f.name.lower(): f for f in have.fields}
        parts = [
            (converted(value[known[f.name.lower()].name], known[f.name.lower()].dataType, f.dataType) if f.name.lower() in known else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: converted(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.transform_values(value, lambda _, x: converted(x, have.valueType, want.valueType))
    return value.cast(want)


def under_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with the columns and types of a wider schema; columns it lacks are NULL."""
    known = {f.name.lower(): f for f in df.schema.fields}
    columns = []
    for field in schema.fields:
        own = known.get(field.name.lower())
        value = F.lit(None).cast(field.dataType) if own is None else converted(F.col(f"`{own.name}`"), own.dataType, field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def widest(schemas: Iterable[T.StructType]) -> T.StructType:
    """One schema for several."""
    found = T.StructType([])
    for schema in schemas:
        found = common_schema(found, schema)
    return found
