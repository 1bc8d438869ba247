import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sluiceway.operators.compare import (
    _moment, bag_diff, bag_diff_by_range, compare_answer_key, compare_expected, compare_tables, differing_ranges, exact_columns, moment,
    row_counts, same_rows,
)
from sluiceway.plans import marts, synth
from sluiceway.sources.literal import literal_table, literal_tables


def test_bags_count_copies_and_ignore_order(table):
    a = table({"x": "int", "y": "string"}, (1, "a"), (1, "a"), (2, None))
    b = table({"x": "int", "y": "string"}, (2, None), (1, "a"), (3, ""))
    assert rows(bag_diff(a, b)) == [(1, "a", 1), (3, "", -1)]
    assert not same_rows(a, b) and same_rows(a, a.orderBy("x"))


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,3)", "date", "timestamp", "timestamp_ntz"])
def test_range_diff_equals_bag_diff(spark, kind):
    r = random.Random(kind)
    exact = spark.range(400).select(F.when(F.col("id") % 41 > 0, F.expr({
        "date": "date_add(date '2024-01-01', cast(id as int))", "timestamp": "timestamp_micros(id * 7777777777)",
        "timestamp_ntz": "cast(timestamp_micros(id * 7777777777 - 5) as timestamp_ntz)",
    }.get(kind, f"cast(id * 3.25 - 200 as {kind})"))).alias("k"), (F.col("id") % 5).alias("v"))
    if kind == "double":
        exact = exact.unionByName(spark.sql("select explode(array(double('NaN'), double('infinity'), -double('infinity'), -0.0d)) as k, 1L as v"))
    listed = exact.collect()
    for _ in range(3):
        changed = [x for x in listed if r.random() > 0.02] + r.sample(listed, 3) + [(r.choice(listed)[0], 9)]
        other = spark.createDataFrame(changed, exact.schema)
        for a, b in ((exact, other), (other, exact)):
            assert rows(bag_diff_by_range(a, b, "k", 16).select(F.col("k").cast("string"), "v", "surplus")) == rows(
                bag_diff(a, b).select(F.col("k").cast("string"), "v", "surplus"))
    spread = exact.repartition(7)
    assert differing_ranges(exact, spread, "k").count() == 0 and bag_diff_by_range(spread, exact, "k").count() == 0


def test_range_diff_of_awkward_tables(spark, table):
    columns = {"k": "bigint", "v": "string"}
    none, one, gone = table(columns), table(columns, (5, "a"), (5, "a")), table(columns, (None, "x"))
    assert rows(bag_diff_by_range(none, one, "k")) == [(5, "a", -2)] and rows(bag_diff_by_range(one, none, "k")) == [(5, "a", 2)]
    assert rows(bag_diff_by_range(one, table(columns, (5, "a")), "k")) == [(5, "a", 1)]
    assert rows(bag_diff_by_range(gone, one, "k")) == [(None, "x", 1), (5, "a", -2)]
    assert rows(bag_diff_by_range(gone, none, "k")) == [(None, "x", 1)] and bag_diff_by_range(none, none, "k").count() == 0
    # Equal numbers of different types are equal; clashing names do no harm.
    assert bag_diff_by_range(one, table({"v": "string", "k": "decimal(9,2)"}, ("a", "5.00"), ("a", "5")), "k").count() == 0
    clash = {"n": "bigint", "_range": "string", "_low": "int", "p0": "int"}
    a = table(clash, (1, "x", 2, 3), (2, None, None, None))
    assert rows(bag_diff_by_range(a, a.where("n = 1"), "n")) == [(2, None, None, None, 1)]
    with pytest.raises(TypeError):
        differing_ranges(one, one, "v")


def test_equal_tables_move_no_rows(spark):
    wide = spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    plan = differing_ranges(wide, wide, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_range") == 1 and plan.count("Exchange") == 1 and "partial_sum" in plan


def test_only_differing_ranges_are_counted(spark):
    a = spark.range(100_000).withColumn("v", F.col("id") % 7)
    b = a.withColumn("v", F.when(F.col("id").isin(500, 50_000), 9).otherwise(F.col("v")))
    diff = bag_diff_by_range(a, b, "id", 100)
    assert rows(diff, "id", "surplus") == [(500, -1), (500, 1), (50_000, -1), (50_000, 1)]
    bounds = differing_ranges(a, b, "id", 100).select("_low", "_high")
    assert all(high - low <= 1000 for low, high in rows(bounds)) and bounds.count() == 2


MOMENTS = [
    "2024-01-01T00:00:00+00:00", "2024-01-01T07:00:00+07", "2024-01-01 07:30:00 +0730", " 2024-01-01T00:00Z ", "2024-01-01T00:00:00.1234560Z",
    "2024-01-01T00:00:00.0000001Z", "2024-01-01", "2024-01-01T10:00", "2024-01-01T10:00.5", "2024-02-30T00:00:00Z", "2024-01-01T25:00:00Z",
    "2024-01-01T00:00:00-05:30", "2024-01-01Z", "yesterday", "", "2024-01-01T00:00:00Z x", "\t2024-01-01T00:00:00.5+01\n",
]


@pytest.mark.parametrize("with_zone", [True, False])
def test_moments_of_a_column_equal_those_of_literals(table, with_zone):
    def literal(text):
        try:
            value = _moment(text, with_zone)
        except ValueError:
            return None
        return (value.astimezone(dt.timezone.utc) if with_zone else value).strftime("%Y-%m-%d %H:%M:%S.%f")

    seen = table({"t": "string"}, *[(m,) for m in MOMENTS], (None,)).select("t", F.date_format(moment(F.col("t"), with_zone), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m"))
    assert dict(rows(seen)) == {m: literal(m) for m in MOMENTS} | {None: None}


def test_row_counts(table):
    a = table({"x": "int"}, (1,), (None,))
    assert rows(row_counts({"a": a, "none": a.where("x = 7")}, {"a": 2, "none": 1})) == [("a", 2, 2, True), ("none", 0, 1, False)]
    for wrong in ({}, {"a": 2, "b": 1}):
        with pytest.raises(ValueError):
            row_counts({"a": a}, wrong)
    with pytest.raises(ValueError):
        row_counts({}, {})


def test_null_is_not_empty(table):
    assert not same_rows(table({"y": "string"}, (None,)), table({"y": "string"}, ("",)))


DEC = {"n": "decimal(38,10)"}


@pytest.mark.parametrize("value,same", [("100", True), ("100.00", True), (100, True), ("100.0000000001", False), (True, False)])
def test_numbers_compare_by_value(table, value, same):
    assert compare_expected(table(DEC, ("100.0",)), [{"n": value}]).ok is same


def test_digits_past_28_matter(table):
    df = table({"n": "decimal(38,30)"}, ("1.123456789012345678901234567890",))
    assert compare_expected(df, [{"n": "1.123456789012345678901234567890"}]).ok
    assert not compare_expected(df, [{"n": "1.123456789012345678901234567891"}]).ok


def test_more_decimals_than_the_column_cannot_match(table):
    assert not compare_expected(table({"n": "decimal(9,2)"}, ("1.00",)), [{"n": "1.001"}]).ok
    assert compare_expected(table({"n": "decimal(9,2)"}, ("1.00",)), [{"n": "1.000"}]).ok


def test_negative_zero_is_zero(table):
    assert compare_expected(table({"d": "double"}, (0.0,)), [{"d": "-0"}]).ok


def test_text_is_exact(table):
    df = table({"code": "string"}, ("00123",))
    assert compare_expected(df, [{"code": "00123"}]).ok
    assert not compare_expected(df, [{"code": "123"}]).ok
    assert not compare_expected(df, [{"code": 123}]).ok


@pytest.mark.parametrize("value,same", [
    ("2024-01-01T00:00:00+00:00", True), ("2024-01-01T07:00:00+07", True), ("2024-01-01T07:00:00+0700", True), ("2024-01-01T00:00:00Z", True),
    ("2024-01-01T00:00:00.0000000Z", True), ("2024-01-01T00:00:00", False), ("2024-01-01T00:00:00.0000001Z", False), ("2024-01-01T01:00:00Z", False),
])
def test_instants(table, value, same):
    df = table({"at": "timestamp"}, ("2024-01-01T00:00:00Z",))
    assert compare_expected(df, [{"at": value}]).ok is same


@pytest.mark.parametrize("value,same", [("2024-01-01T05:00:00", True), ("2024-01-01 05:00:00+07", True), (dt.datetime(2024, 1, 1, 5), True), ("2024-01-01", False)])
def test_wall_clocks_ignore_a_zone(table, value, same):
    df = table({"at": "timestamp_ntz"}, ("2024-01-01T05:00:00",))
    assert compare_expected(df, [{"at": value}]).ok is same


def test_only_declared_columns_are_compared(table):
    df = table({"a": "int", "b": "string"}, (1, "x"), (1, "y"))
    assert compare_expected(df, [{"a": 1}, {"a": 1}], row_count=2).ok
    assert not compare_expected(df, [{"a": 1}]).ok
    assert not compare_expected(df, [{"a": 1}, {"a": 1}], row_count=3).ok
    assert not compare_expected(df, [{"a": 1}, {"b": "x"}]).ok
    assert not compare_expected(df, [{"z": 1}]).ok
    assert not compare_expected(df, []).ok and compare_expected(df.limit(0), []).ok


def test_exact_columns(table):
    df = table({"a": "int", "b": "timestamp_ntz"})
    assert exact_columns(df, {"b": "timestamp_ntz", "a": "int"}).ok
    assert not exact_columns(df, {"a": "int"}).ok
    assert not exact_columns(df, {"a": "bigint", "b": "timestamp_ntz"}).ok


def test_several_tables(table):
    tables = {"x": table({"a": "int"}, (1,)), "y": table({"a": "int"}, (2,))}
    assert compare_tables(tables, {"x": [{"a": 1}], "y": [{"a": 2}]}).ok
    bad = compare_tables(tables, {"x": [{"a": 1}], "y": [{"a": 3}]})
    assert not bad.ok and bad.detail.startswith("y:")


def test_literal_tables(spark):
    made = literal_tables(spark, [{"name": "t", "columns": {"id": "bigint", "at": "timestamp", "d": "decimal(9,2)"},
                                   "rows": [{"id": 1, "at": "2024-01-01T00:00:00+02:00", "d": "1.5"}, {"id": 2}]}])["t"]
    assert rows(made, "id", "d") == [(1, Decimal("1.50")), (2, None)]
    with pytest.raises(ValueError, match="undeclared"):
        literal_table(spark, {"id": "int"}, [{"id": 1, "nope": 2}])
    with pytest.raises(ValueError, match="twice"):
        literal_tables(spark, [{"name": "t", "columns": {"a": "int"}}] * 2)


@pytest.mark.parametrize("partitions", [1, 7])
def test_made_orders_against_the_answer_key(spark, partitions):
    """The key is worked out in plain Python; partitioning must not matter."""
    made = synth.orders(spark, 3000).repartition(partitions)
    facts = marts.monthly_revenue(made)
    checks = compare_answer_key(facts, synth.answer_key(3000), made, "id", 3000)
    assert checks == dict.fromkeys(checks, True) and len(checks) == 5
    assert same_rows(facts, synth.answer_key_at_scale(made))
    wrong = [{**synth.answer_key(3000)[0], "orders": 0}, *synth.answer_key(3000)[1:]]
    assert not compare_answer_key(facts, wrong, made, "id", 3000)["fact_rows"]


def test_made_orders_stay_in_their_ranges(spark):
    seen = synth.orders(spark, 2000).selectExpr("min(order_date) a", "max(order_date) b", "min(amount) lo", "max(amount) hi", "count(distinct status) s", "count(distinct customer) c").first()
    assert dt.date(2025, 1, 1) <= seen["a"] and seen["b"] <= dt.date(2026, 12, 31)
    assert Decimal("1.00") <= seen["lo"] and seen["hi"] <= Decimal("10000.00") and seen["s"] == 4 and seen["c"] <= 99
