"""Made-up orders as a function of seed and id alone: the same on any number of tasks, and re-runnable in part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OrderRules:
    """The seed, months, status weights and amount range of the reference data set."""

    seed: int = 20261021
    first_month: tuple[int, int] = (2025, 1)
    last_month: tuple[int, int] = (2026, 12)
    statuses: Mapping[str, int] = field(default_factory=lambda: {"done": 60, " DONE ": 10, "cancelled": 15, "draft": 15})
    amount_cents: tuple[int, int] = (100, 1_000_000)
    orders_per_customer: int = 20

    @property
    def months(self) -> list[tuple[int, int]]:
        (y, m), out = self.first_month, []
        while (y, m) <= self.last_month:
            out.append((y, m))
            y, m = (y, m + 1) if m < 12 else (y + 1, 1)
        return out


# Hex digits of md5('seed-id') that decide each field.
_DIGITS = {"month": (1, 6), "day": (7, 6), "status": (13, 6), "cents": (19, 8), "customer": (27, 6)}


def orders_for(ids: DataFrame, id_column: str, count: int, rules: OrderRules = OrderRules()) -> DataFrame:
    """An order for each id; `count` sets the number of customers."""
    digest = F.md5(F.concat(F.lit(f"{rules.seed}-"), F.col(id_column).cast("string")))

    def number(name: str) -> Column:
        start, length = _DIGITS[name]
        return F.conv(F.substring(F.col("_d"), start, length), 16, 10).cast("bigint")

    first_days = F.array(*[F.lit(f"{y:04d}-{m:02d}-01").cast("date") for y, m in rules.months])
    month = F.element_at(first_days, (number("month") % len(rules.months) + 1).cast("int"))
    day = F.date_add(F.col("_m"), (number("day") % F.dayofmonth(F.last_day("_m"))).cast("int"))
    total, status, reached = sum(rules.statuses.values()), None, 0
    for name, weight in rules.statuses.items():
        reached += weight
        test = number("status") % total < reached
        status = F.when(test, name) if status is None else status.when(test, name)
    low, high = rules.amount_cents
    cents = number("cents") % (high - low + 1) + low
    customers = max(2, count // rules.orders_per_customer) - 1
    return ids.select(F.col(id_column).cast("bigint").alias("id"), digest.alias("_d")).withColumn("_m", month).select(
        "id", day.alias("order_date"), status.alias("status"),
        (cents.cast("decimal(18,0)") / 100).cast("decimal(20,2)").alias("amount"),
        F.concat(F.lit("c"), F.lpad((number("customer") % customers + 1).cast("string"), 7, "0")).alias("customer"),
    )


def orders(spark: SparkSession, count: int, rules: OrderRules = OrderRules()) -> DataFrame:
    return orders_for(spark.range(1, count + 1), "id", count, rules)


def _plain_rows(count: int, rules: OrderRules) -> Iterator[tuple[str, str, int]]:
    """(month, status, cents) of each order in plain Python, for small counts."""
    months, (low, high) = rules.months, rules.amount_cents
    choices = [s for s, w in rules.statuses.items() for _ in range(w)]
    for i in range(1, count + 1):
        digest = hashlib.md5(f"{rules.seed}-{i}".encode()).hexdigest()
        value = {n: int(digest[a - 1 : a - 1 + k], 16) for n, (a, k) in _DIGITS.items()}
        y, m = months[value["month"] % len(months)]
        yield f"{y:04d}-{m:02d}", choices[value["status"] % len(choices)], value["cents"] % (high - low + 1) + low


def answer_key(count: int, rules: OrderRules = OrderRules()) -> list[dict]:
    """Completed orders and revenue by month, worked out in integer cents without Spark. For small counts."""
    by_month: dict[str, list[int]] = {}
    for month, status, cents in _plain_rows(count, rules):
        if status.strip().lower() == "done":
            entry = by_month.setdefault(month, [0, 0])
            entry[0] += 1
            entry[1] += cents
    return [
        {"month": k, "orders": n, "revenue": f"{cents // 100}.{cents % 100:02d}"} for k, (n, cents) in sorted(by_month.items())
    ]


def answer_key_at_scale(made: DataFrame) -> DataFrame:
    """The same key by another way than the mart: integer cents and the calendar fields of the date."""
    cents = (F.col("amount") * 100).cast("bigint")
    done = made.where(F.regexp_like("status", F.lit("(?i)^ *done *$")))
    month = F.format_string("%04d-%02d", F.year("order_date"), F.month("order_date"))
    return done.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), (F.sum(cents).cast("decimal(28,0)") / 100).cast("decimal(30,2)").alias("revenue")
    )
