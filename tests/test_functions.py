import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluiceway.functions import (
    blank_to_null, clean, due_at, integral_text, is_live, is_strictly_true, month_key, percentage, range_label, reason,
    surrogate_key, upper_clean, wall_clock, with_rate,
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [("  a b ", "a b"), ("   ", None), ("", None), (None, None), ("\ta", "\ta"), (" ", " ")])
def test_clean_trims_spaces_only(spark, text, expected):
    assert one(spark, clean(F.lit(text))) == expected


def test_clean_takes_numbers(spark):
    assert one(spark, clean(F.lit(7))) == "7"


def test_blank_to_null_does_not_trim(spark):
    assert one(spark, blank_to_null(F.lit(" "))) == " "
    assert one(spark, blank_to_null(F.lit(""))) is None


def test_upper_clean(spark):
    assert one(spark, upper_clean(F.lit(" ab1 "))) == "AB1"


def test_surrogate_key_tells_null_from_empty(spark):
    null = one(spark, surrogate_key(F.lit("a"), F.lit(None).cast("string")))
    empty = one(spark, surrogate_key(F.lit("a"), F.lit("")))
    assert null == hashlib.md5(b"a-_dbt_utils_surrogate_key_null_").hexdigest()
    assert empty == hashlib.md5(b"a-").hexdigest()


def test_surrogate_key_known_value(spark):
    assert one(spark, surrogate_key(F.lit(101))) == "38b3eff8baf56627478ec76a704e9b52"


def test_month_and_wall_clock(spark):
    assert one(spark, month_key(F.lit(dt.datetime(2026, 1, 31, 23, 59)).cast("timestamp_ntz"))) == "2026-01"
    assert one(spark, wall_clock(F.lit("2024-01-01T00:00:00+02:00").cast("timestamp"))) == dt.datetime(2023, 12, 31, 22)


def test_due_at(spark):
    placed = F.lit("2026-01-01 10:00:00").cast("timestamp_ntz")
    assert one(spark, due_at(F.lit(None).cast("timestamp_ntz"), placed, 72)) == dt.datetime(2026, 1, 4, 10)
    assert one(spark, due_at(F.lit("2026-02-01").cast("timestamp_ntz"), placed, 72)) == dt.datetime(2026, 2, 1)


@pytest.mark.parametrize("amount,expected", [("10.05", "11.06"), ("100.00", "110.00"), ("-10.05", "-11.06"), ("0.04", "0.04")])
def test_rate_rounds_half_up(spark, amount, expected):
    assert one(spark, with_rate(F.lit(Decimal(amount)), "1.10")) == Decimal(expected)


@pytest.mark.parametrize("part,whole,expected", [(2, 3, "66.7"), (1, 3, "33.3"), (1, 16, "6.3"), (1, 1, "100.0")])
def test_percentage(spark, part, whole, expected):
    assert one(spark, percentage(F.lit(part), F.lit(whole))) == Decimal(expected)


@pytest.mark.parametrize("value,expected", [(12.0, "12"), (12.5, "12.5"), (-3.0, "-3"), (None, None)])
def test_integral_text(spark, value, expected):
    assert one(spark, integral_text(F.lit(value).cast("double"))) == expected


def test_three_valued_flags(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, is_strictly_true(null)) is False
    assert one(spark, is_live(null)) is True
    assert one(spark, is_live(F.lit(True))) is False


def test_range_label(spark):
    groups = ((1, 1, "1"), (2, 3, "2-3"), (6, None, ">5"))
    assert [one(spark, range_label(F.lit(v), groups)) for v in (1, 3, 5, 6, 99)] == ["1", "2-3", None, ">5", ">5"]
    with pytest.raises(ValueError):
        range_label("x", ())


def test_reason_shows_null_as_empty(spark):
    assert one(spark, reason("a=%s b=%s", F.lit(1), F.lit(None).cast("int"))) == "a=1 b="
