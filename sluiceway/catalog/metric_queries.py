"""Charts over a dataset of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.catalog.base import Tables, query
from sluiceway.functions import money, month_key
from sluiceway.plans.metrics import Chart, Dataset, DatasetColumn

ORDERS = Dataset(
    columns=[
        DatasetColumn("status"), DatasetColumn("priority"), DatasetColumn("month", temporal=True),
        DatasetColumn("customer", groupby=False), DatasetColumn("amount", groupby=False, filterable=False),
    ],
    metrics={
        "rows": "COUNT(*)", "customers": "COUNT(DISTINCT customer)", "months": "COUNT(DISTINCT month)",
        "revenue": "SUM(amount)", "largest": "MAX(amount)",
    },
)
CHARTS = {
    "totals": Chart(metrics=["rows", "customers", "months", "revenue", "largest"]),
    "by_priority": Chart(metrics=["rows", "revenue"], columns=["priority"]),
}
_SQL = """with data as (select o_orderstatus as status, o_orderpriority as priority, strftime(o_orderdate, '%Y-%m') as month,
                               o_custkey as customer, cast(o_totalprice as decimal(20,2)) as amount from orders) """


def _data(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        month_key("o_orderdate").alias("month"), F.col("o_custkey").alias("customer"), money("o_totalprice").alias("amount"),
    )


@query("chart_totals", "B1 B4", _SQL + """
    select count(*) as rows, count(distinct customer) as customers, count(distinct month) as months, cast(sum(amount) as decimal(30,2)) as revenue, max(amount) as largest from data""")
def chart_totals(t: Tables) -> DataFrame:
    return ORDERS.query(_data(t), CHARTS["totals"])


@query("chart_grouped", "B1 B2 B3", _SQL + "select priority, count(*) as rows, cast(sum(amount) as decimal(30,2)) as revenue from data group by 1")
def chart_grouped(t: Tables) -> DataFrame:
    return ORDERS.query(_data(t), CHARTS["by_priority"])


@query("chart_filtered", "B3 B5", _SQL + """
    select priority, count(*) as rows, cast(sum(amount) as decimal(30,2)) as revenue from data
    where status in ('F', 'P') and month in ('1996-01', '1996-02') group by 1""")
def chart_filtered(t: Tables) -> DataFrame:
    filters = {"status": ["F", "P"], "month": ["1996-01", "1996-02"]}
    return ORDERS.dashboard(_data(t), CHARTS, filters)["by_priority"]


@query("chart_top_rows", "B3", _SQL + "select month, cast(sum(amount) as decimal(30,2)) as revenue from data group by 1 order by revenue desc, month limit 12")
def chart_top_rows(t: Tables) -> DataFrame:
    """The row limit is the chart's own."""
    chart = Chart(metrics=["revenue"], columns=["month"], row_limit=12, order=[F.desc("revenue"), F.asc("month")])
    return ORDERS.query(_data(t), chart)


@query("chart_agreement", "B6", _SQL + "select priority, count(*) as rows, cast(sum(amount) as decimal(30,2)) as revenue, cast(2 as bigint) as seen from data group by 1")
def chart_agreement(t: Tables) -> DataFrame:
    """A chart and an independent query give the same rows, as bags."""
    independent = t.spark.sql(
        "select o_orderpriority as priority, count(*) as rows, sum(cast(o_totalprice as decimal(20,2))) as revenue from {o} group by 1",
        o=t.orders,
    )
    both = ORDERS.query(_data(t), CHARTS["by_priority"]).unionByName(independent)
    return both.groupBy("priority", "rows", "revenue").agg(F.count(F.lit(1)).alias("seen"))
