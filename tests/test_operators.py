import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sluiceway import skew
from sluiceway.functions import asc, desc
from sluiceway.operators import aggregate, dedupe, joins
from sluiceway.operators.asof import with_asof
from sluiceway.operators.merge import merge_changes, past_cursor
from sluiceway.operators.ranking import position_in_group


def test_keep_first_puts_null_time_first(table):
    df = table({"id": "string", "at": "date"}, ("a", "2026-01-01"), ("a", None), ("b", "2026-01-02"), ("b", "2026-01-03"), (" b", "2026-01-01"))
    kept = dedupe.keep_first(df, ["id"], [desc("at")])
    assert rows(kept) == [(" b", dt.date(2026, 1, 1)), ("a", None), ("b", dt.date(2026, 1, 3))]


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = dedupe.keep_first(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [asc("id")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_keep_one_is_repeatable(table):
    df = table({"id": "int", "x": "string"}, (1, "b"), (1, "a"), (1, None), (2, None))
    assert rows(dedupe.keep_one(df, ["id"])) == rows(dedupe.keep_one(df.orderBy(F.desc("x")), ["id"])) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_position_in_hot_groups_equals_the_window(spark, seed):
    """One group holds most rows, with exact copies and NULL keys; ranges must give the window's numbers."""
    pick = random.Random(seed)
    data = [(pick.choice([1, 1, 1, 1, 2, None]), pick.choice([None, *range(5)]), pick.randrange(3)) for _ in range(900)]
    df = spark.createDataFrame(data, "g int, a int, b int")
    order = [desc("a"), asc("b")]
    plain = position_in_group(df, ["g"], order)
    ranged = position_in_group(df, ["g"], order, rows_per_task=100)
    assert rows(plain) == rows(ranged)
    assert ranged.columns == plain.columns


def test_hot_groups_list_is_whole(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    assert skew.hot_groups(df, ["k"], rows_per_task=100) is None
    listed = skew.hot_groups(df, ["k"], rows_per_task=99)
    assert listed.count() == 10 and "hint" in str(listed._jdf.queryExecution().logical()).lower()
    long = skew.hot_groups(df, ["k"], rows_per_task=99, max_rows=3)
    assert long.count() == 10 and "hint" not in str(long._jdf.queryExecution().logical()).lower()


def test_broadcast_needs_a_checked_size(spark):
    df = spark.range(100)
    assert skew.is_small(df, max_rows=100) and not skew.is_small(df, max_rows=99)
    assert not skew.is_small(df, max_bytes=10)
    assert skew.is_small(df.limit(0))


@pytest.mark.parametrize("bound", [1, 7, 50_000])
def test_ordered_concat(spark, bound):
    pick = random.Random(3)
    data = [(pick.choice(["a", "a", "a", "b", None]), i, pick.choice([None, "x", "y"])) for i in range(60)]
    pick.shuffle(data)
    df = spark.createDataFrame(data, "g string, n int, t string")
    expected = {}
    for g, _, t in sorted(data, key=lambda r: r[1]):
        if t is not None:
            expected.setdefault(g, []).append(t)
    got = aggregate.ordered_concat(df, ["g"], F.col("t"), ["n"], "all", "-", rows_per_task=bound)
    assert {r["g"]: r["all"] for r in got.collect()} == {g: "-".join(v) for g, v in expected.items()}


def test_without_listed_ignores_null_entries(table):
    left = table({"k": "string"}, ("a",), ("b",), (None,))
    assert rows(joins.without_listed(left, table({"x": "string"}, ("a",), (None,)), F.col("k"), "x")) == [(None,), ("b",)]


def test_enrich_keeps_unmatched_rows(table):
    left = table({"id": "int", "ref": "int"}, (1, 10), (2, 99), (3, None))
    right = table({"key": "int", "name": "string"}, (10, "ten"), (None, "none"))
    assert rows(joins.enrich(left, right, F.col("ref"), F.col("key"), ["name"])) == [(1, 10, "ten"), (2, 99, None), (3, None, None)]


def test_mixed_values_ignores_null(table):
    df = table({"k": "int", "v": "int"}, (1, 5), (1, 5), (2, 5), (2, 6), (3, None), (3, 4))
    assert rows(aggregate.mixed_values(df, "k", "v")) == [(2,)]


def brute_force_asof(orders, rates, lookback):
    out = []
    for i, cur, day in orders:
        best = [(d, r) for c, d, r in rates if c == cur and r is not None and 0 <= (day - d).days <= lookback] if cur is not None else []
        out.append((i, max(best)[1] if best else None))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_asof_against_brute_force(spark, seed):
    pick, start = random.Random(seed), dt.date(2026, 1, 1)
    orders = [(i, pick.choice([1, 1, 1, 2, 3, None]), start + dt.timedelta(pick.randrange(60))) for i in range(150)]
    rates = [(pick.choice([1, 2]), start + dt.timedelta(pick.randrange(60)), pick.choice([None, *range(1, 9)])) for _ in range(25)]
    facts = spark.createDataFrame(orders, "id int, cur int, day date")
    values = spark.createDataFrame(rates, "cur int, rate_date date, rate int")
    got = with_asof(facts, values, ["cur"], "day", "rate_date", "rate", 5)
    assert rows(got, "id", "rate") == sorted(brute_force_asof(orders, rates, 5), key=lambda r: r[0])


def test_asof_edges(table):
    facts = table({"id": "int", "cur": "int", "day": "date"}, (1, 7, "2026-01-10"), (2, 7, "2026-01-15"), (3, 7, "2026-01-16"), (4, None, "2026-01-10"), (5, 8, "2026-01-12"))
    values = table({"cur": "int", "rate_date": "date", "rate": "decimal(6,2)"}, (7, "2026-01-10", "1.5"), (8, "2026-01-10", "2"), (8, "2026-01-11", "3"), (8, "2026-01-12", None))
    got = {r["id"]: r["rate"] for r in with_asof(facts, values, ["cur"], "day", "rate_date", "rate", 5).collect()}
    assert got == {1: Decimal("1.50"), 2: Decimal("1.50"), 3: None, 4: None, 5: Decimal("3.00")}


def test_merge_changes(table):
    columns = {"id": "int", "at": "int", "v": "string"}
    base = table(columns, (1, 1, "old"), (2, 1, "kept"))
    delta = table(columns, (1, 2, "mid"), (1, 3, "new"), (3, 2, "added"))
    once = merge_changes(base, delta, ["id"], "at")
    assert rows(once) == [(1, 3, "new"), (2, 1, "kept"), (3, 2, "added")]
    assert rows(merge_changes(once, delta, ["id"], "at")) == rows(once)


def test_past_cursor_reads_the_boundary_again(table):
    df = table({"id": "int", "at": "int"}, (1, 1), (2, 2), (3, 3))
    assert rows(past_cursor(df, "at", 2), "id") == [(2,), (3,)]
    assert past_cursor(df, "at", None).count() == 3
