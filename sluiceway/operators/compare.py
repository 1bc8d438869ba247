"""Exact, order-independent comparison of results."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The same form as _MOMENT below, with groups by number: day, time, fraction, zone.
_MOMENT_TEXT = r"\A(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d)?)(?:\.(\d+))?\s*(Z|[+-]\d\d(?::?\d\d)?)?)?\z"


@dataclass(frozen=True)
class Comparison:
    ok: bool
    detail: str = ""


def bag_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with the surplus: positive means too many in `actual`.

    Copies count and NULL equals NULL. Both sides are counted in one aggregate that combines before
    its single shuffle; nothing is sorted, and copies never travel.
    """
    columns = actual.columns
    both = actual.select(*columns, F.lit(1).cast("bigint").alias("_side")).unionByName(
        expected.select(*columns, F.lit(-1).cast("bigint").alias("_side"))
    )
    return both.groupBy(*columns).agg(F.sum("_side").alias("surplus")).where("surplus <> 0")


RANGES = 256
RANGE, LOW, HIGH = "_range", "_low", "_high"
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _hash_parts(columns: Sequence[str]) -> list[Column]:
    """128 bits over a row in six numbers of at most 22 bits, which can be added up for 2^41 rows without overflow."""
    both = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *reversed(columns))]
    return [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 22) - 1)) for h in both for at in (0, 22, 44)]


def _alike(actual: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns of `actual` in the types a union of them has, so that equal values hash alike."""
    columns = actual.columns
    schema = actual.unionByName(expected.select(*columns)).schema
    return tuple(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) for df in (actual, expected))


def _place(key: str, kind: T.DataType) -> Column:
    """A key value as a number that grows with it."""
    value = F.unix_micros(F.col(key).cast("timestamp")) if isinstance(kind, _TIMES) else F.col(key)
    return value.cast("double")


def _range_of(key: str, kind: T.DataType, ends, ranges: int) -> Column:
    """The equal-width range of a key value: 0 below the lowest end, `ranges` + 1 from the highest on, one more for what is
    no number, and -1 for NULL."""
    if ends is None:
        within = F.lit(0)
    elif ends["low"] == ends["high"]:
        within = (_place(key, kind) >= ends["high"]).cast("int")
    else:
        within = F.coalesce(F.width_bucket(_place(key, kind), F.lit(ends["low"]), F.lit(ends["high"]), F.lit(ranges)), F.lit(ranges + 2))
    return F.when(F.col(key).isNull(), -1).otherwise(within).cast("bigint")


def differing_ranges(actual: DataFrame, expected: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """Ranges of `key` in which the two bags differ, with the key values they run between on both sides.

    The hashes of a range's rows are added up, with opposite signs for the two sides: a sum does not depend on the order or
    the spread of the rows, and copies count. What is shuffled is one line of sums for each range and task, not the rows.
    Two different bags of one range have equal sums with a probability of about 2^-128. `key` is a numeric, date or time
    column; its ranges are of equal width, so a crowded one only means more rows to count should it differ.
    """
    kind = actual.schema[key].dataType
    if not isinstance(kind, (T.NumericType, *_TIMES)):
        raise TypeError(f"{key} is a {kind.simpleString()}: ranges need a numeric, date or time column")
    place = _place(key, kind)
    ends = expected.where(F.abs(place) < float("inf")).agg(F.min(place).alias("low"), F.max(place).alias("high")).first()
    ends = None if ends["low"] is None else ends
    within, columns = _range_of(key, kind, ends, ranges).alias(RANGE), actual.columns
    signed = [
        df.select(within, F.col(key).alias(LOW), F.lit(sign).cast("bigint").alias("n"), *[(p * sign).alias(f"p{i}") for i, p in enumerate(_hash_parts(columns))])
        for df, sign in zip(_alike(actual, expected), (1, -1))
    ]
    sums = ["n", *[f"p{i}" for i in range(6)]]
    found = signed[0].unionByName(signed[1]).groupBy(RANGE).agg(
        F.min(LOW).alias(LOW), F.max(LOW).alias(HIGH), *[F.sum(c).alias(c) for c in sums]
    )
    return found.where(" or ".join(f"{c} <> 0" for c in sums)).select(RANGE, LOW, HIGH)


def bag_diff_by_range(actual: DataFrame, expected: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """`bag_diff` for large tables that should be equal: only the rows of differing ranges are counted.

    At most `ranges` + 4 lines come to the driver. The ranges become bounds on `key`, which reach the files, so that a table
    written in key order is only read where it differs.
    """
    left, right = _alike(actual, expected)
    kind = left.schema[key].dataType
    found = differing_ranges(left, right, key, ranges).select(RANGE, F.col(LOW).cast("string"), F.col(HIGH).cast("string"))
    inside, runs = F.lit(False), []
    for line in found.orderBy(RANGE).collect():
        if line[RANGE] == -1:
            inside = F.col(key).isNull()
        elif runs and line[RANGE] == runs[-1][0] + 1:
            runs[-1] = (line[RANGE], runs[-1][1], line[HIGH])
        else:
            runs.append((line[RANGE], line[LOW], line[HIGH]))
    for _, low, high in runs:
        inside = inside | F.col(key).between(F.lit(low).cast(kind), F.lit(high).cast(kind))
    return bag_diff(left.where(inside), right.where(inside))


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Rows of each table beside the number it should have, all counted by one job; a table without a number has to be
    named in neither."""
    if set(tables) != set(expected):
        raise ValueError(f"tables and expected counts differ: {sorted(set(tables) ^ set(expected))}")
    if not tables:
        raise ValueError("row_counts needs at least one table")
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(expected[name]).cast("bigint").alias("expected"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted).withColumn("ok", F.col("rows") == F.col("expected"))


def moment(text: Column, with_zone: bool = True) -> Column:
    """ISO text as a point in time (or, without zone, as the wall clock it shows), by the rules for expected literals: up to
    a microsecond exactly, and a point in time has to say its offset. Text of another form is NULL."""
    text = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))

    def group(i: int) -> Column:
        return F.regexp_extract(text, _MOMENT_TEXT, i)

    part, zone = F.rtrim(group(3), F.lit("0")), group(4)
    clock = F.when(group(2) == "", "00:00:00").when(F.length(group(2)) == 5, F.concat(group(2), F.lit(":00"))).otherwise(group(2))
    wall = F.concat(group(1), F.lit("T"), clock, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    exact = (group(1) != "") & (F.length(part) <= 6)
    if not with_zone:
        return F.when(exact, wall.try_cast("timestamp_ntz"))
    minutes = F.when(F.length(zone) > 3, F.substring(zone, -2, 2)).otherwise(F.lit("00"))
    away = F.when(zone == "Z", "Z").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), minutes))
    return F.when(exact & (zone != ""), F.concat(wall, away).try_cast("timestamp"))


def same_rows(actual: DataFrame, expected: DataFrame) -> bool:
    return bag_diff(actual, expected).limit(1).count() == 0


def exact_columns(df: DataFrame, columns: Mapping[str, str]) -> Comparison:
    """The table has exactly these columns with exactly these types (Spark type names), in any order."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = {c: T.DataType.fromDDL(t).simpleString() for c, t in columns.items()}
    if actual == wanted:
        return Comparison(True, f"{len(actual)} column(s) as declared")
    return Comparison(False, f"columns {dict(sorted(actual.items()))} are not exactly {dict(sorted(wanted.items()))}")


_MOMENT = re.compile(r"(?P<day>\d{4}-\d\d-\d\d)(?:[T ](?P<time>\d\d:\d\d(?::\d\d)?)(?:\.(?P<part>\d+))?\s*(?P<zone>Z|[+-]\d\d(?::?\d\d)?)?)?")


def _moment(value, with_zone: bool):
    """A day or point in time, as a value or as ISO text. Digits past the microsecond must be zero, and a point with a
    time zone must say which."""
    if isinstance(value, dt.datetime):
        stamp = value
    else:
        found = _MOMENT.fullmatch(value.strip() if isinstance(value, str) else value.isoformat())
        if not found:
            raise ValueError(f"{value!r} is not a timestamp")
        part = (found["part"] or "").rstrip("0")
        if len(part) > 6:
            raise ValueError(f"{value!r} is finer than a microsecond")
        zone = found["zone"] or ""
        stamp = dt.datetime.fromisoformat(f"{found['day']}T{found['time'] or '00:00'}").replace(microsecond=int(part.ljust(6, "0")))
        if zone:
            hours, minutes = (0, 0) if zone == "Z" else (int(zone[1:3]), int(zone[-2:]) if len(zone) > 3 else 0)
            away = dt.timedelta(hours=hours, minutes=minutes)
            stamp = stamp.replace(tzinfo=dt.timezone(-away if zone[0] == "-" else away))
    if with_zone and stamp.tzinfo is None:
        raise ValueError(f"{value!r} does not say its offset")
    return stamp if with_zone else stamp.replace(tzinfo=None)


def _typed(value, kind: T.DataType):
    """One expected literal in the type of the column it is compared with; raises if it has no such form."""
    if value is None:
        return None
    if isinstance(kind, T.TimestampType):
        return _moment(value, True)
    if isinstance(kind, T.TimestampNTZType):
        return _moment(value, False)
    if isinstance(kind, T.DateType):
        return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise ValueError(f"{value!r} is not a boolean")
        return value
    if isinstance(kind, T.NumericType):
        number = Decimal(str(value))
        if isinstance(kind, T.DecimalType):
            with localcontext(prec=200):
                if number != number.quantize(Decimal(1).scaleb(-kind.scale)):
                    raise ValueError(f"{value!r} has more than {kind.scale} decimals")
            return number
        if isinstance(kind, T.IntegralType):
            if number != number.to_integral_value():
                raise ValueError(f"{value!r} is not a whole number")
            return int(number)
        return float(number)
    return str(value)


def expected_frame(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType) -> DataFrame:
    """Literal rows as a DataFrame in the types of the table they are compared with.

    A quoted number is a number on a numeric column; on a text column '00123' stays '00123'.
    """
    data = [tuple(_typed(row[f.name], f.dataType) for f in schema.fields) for row in rows]
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.createDataFrame(data, nullable)


def compare_expected(
    actual: DataFrame,
    rows: Sequence[Mapping],
    columns: Mapping[str, str] | None = None,
    row_count: int | None = None,
) -> Comparison:
    """`actual` holds exactly the expected rows, on the columns those rows declare."""
    if columns is not None:
        contract = exact_columns(actual, columns)
        if not contract.ok:
            return contract
    if row_count is not None:
        n = actual.count()
        if n != row_count:
            return Comparison(False, f"expected {row_count} row(s), got {n}")
    if not rows:
        n = actual.limit(1).count()
        return Comparison(n == 0, "0 row(s) matched exactly" if n == 0 else "expected no rows, got some")
    names = sorted(rows[0])
    if any(sorted(r) != names for r in rows):
        return Comparison(False, "the expected rows do not all declare the same columns")
    missing = [c for c in names if c not in actual.columns]
    if missing:
        return Comparison(False, f"no such column(s): {missing}")
    seen = actual.select(*names)
    try:
        wanted = expected_frame(actual.sparkSession, rows, seen.schema)
    except (ValueError, ArithmeticError) as exc:
        return Comparison(False, f"could not compare: {exc}")
    sample = bag_diff(seen, wanted).limit(5).collect()
    if sample:
        return Comparison(False, "surplus rows (+ actual, - expected): " + "; ".join(str(r.asDict()) for r in sample))
    return Comparison(True, f"{len(rows)} row(s) matched exactly")


def compare_tables(
    tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[Mapping]], **options: Mapping
) -> Comparison:
    """Several tables in one verdict; a failure names every table that differs."""
    results = {
        name: compare_expected(tables[name], rows, **options.get(name, {})) for name, rows in expected.items()
    }
    bad = {n: r for n, r in results.items() if not r.ok}
    return Comparison(not bad, "\n".join(f"{n}: {r.detail}" for n, r in (bad or results).items()))


def compare_answer_key(
    facts: DataFrame, key_rows: Sequence[Mapping], landing: DataFrame, id_column: str, landing_rows: int
) -> dict[str, bool]:
    """Five checks of a generated run: fact rows, landing rows, distinct ids, and both grand totals."""
    counts = landing.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_column).alias("d")).first()
    totals = facts.agg(F.sum("orders").alias("o"), F.sum("revenue").alias("r")).first()
    return {
        "fact_rows": compare_expected(facts, key_rows).ok,
        "landing_rows": counts["n"] == landing_rows,
        "distinct_ids": counts["d"] == landing_rows,
        "total_orders": (totals["o"] or 0) == sum(int(r["orders"]) for r in key_rows),
        "total_revenue": (totals["r"] or 0) == sum((Decimal(str(r["revenue"])) for r in key_rows), Decimal(0)),
    }


def type_audit(df: DataFrame, **measures) -> DataFrame:
    """Column types, session zone and chosen measures as one row."""
    spark = df.sparkSession
    aggregates = [m.alias(n) for n, m in measures.items()] or [F.count(F.lit(1)).alias("rows")]
    return df.agg(*aggregates).withColumns({
        "timezone": F.lit(spark.conf.get("spark.sql.session.timeZone")),
        "column_types": F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)),
    })
