"""Comparison operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.catalog.base import Tables, query
from sluiceway.functions import money
from sluiceway.operators.compare import bag_diff, bag_diff_by_range, moment, row_counts, type_audit
from sluiceway.plans import marts, synth


@query("bag_diff", "C1 C5", """
    with a as (select l_partkey, l_returnflag from lineitem where l_linenumber <= 4),
         b as (select l_partkey, l_returnflag from lineitem where l_linenumber >= 3)
    select l_partkey, l_returnflag, count(*) as surplus from (select * from a except all select * from b) group by 1, 2
    union all select l_partkey, l_returnflag, -count(*) from (select * from b except all select * from a) group by 1, 2""")
def bag_diff_query(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_linenumber <= 4").select("l_partkey", "l_returnflag")
    return bag_diff(a, t.lineitem.where("l_linenumber >= 3").select("l_partkey", "l_returnflag"))


@query("bag_diff_nulls", "C1 C2 C3 C5", """
    with a as (select nullif(l_returnflag, 'N') as flag, cast(l_quantity as decimal(12,2)) as quantity from lineitem),
         b as (select case l_returnflag when 'N' then '' else l_returnflag end as flag, cast(l_quantity as decimal(12,2)) as quantity from lineitem where l_linenumber < 7)
    select flag, quantity, count(*) as surplus from (select * from a except all select * from b) group by 1, 2
    union all select flag, quantity, -count(*) from (select * from b except all select * from a) group by 1, 2""")
def bag_diff_nulls(t: Tables) -> DataFrame:
    """NULL equals NULL but not the empty text; 5 equals 5.00."""
    a = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), money("l_quantity", 12).alias("quantity"))
    empty = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    b = t.lineitem.where("l_linenumber < 7").select(empty.alias("flag"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return bag_diff(a, b.withColumn("quantity", F.col("quantity").cast("decimal(12,2)")))


_CHANGED = """select l_orderkey, l_linenumber, case when l_orderkey % 4999 = 7 then l_quantity + 1 else l_quantity end as quantity, l_shipdate as shipped from lineitem
        where l_orderkey % 5003 <> 11 union all select l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem where l_orderkey % 5009 = 13"""


@query("bag_diff_ranges", "C1 C8", f"""
    with a as (select l_orderkey, l_linenumber, l_quantity as quantity, l_shipdate as shipped from lineitem), b as ({_CHANGED})
    select l_orderkey, l_linenumber, quantity, shipped, count(*) as surplus from (select * from a except all select * from b) group by all
    union all select l_orderkey, l_linenumber, quantity, shipped, -count(*) from (select * from b except all select * from a) group by all""")
def bag_diff_ranges(t: Tables) -> DataFrame:
    """All lines against a copy in which lines were changed, left out and repeated: only ranges that differ are counted."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("shipped"))
    other = F.when(F.col("l_orderkey") % 4999 == 7, F.col("quantity") + 1).otherwise(F.col("quantity"))
    changed = lines.where("l_orderkey % 5003 <> 11").withColumn("quantity", other)
    return bag_diff_by_range(lines, changed.unionByName(lines.where("l_orderkey % 5009 = 13")), "l_orderkey")


@query("moments_compared", "C4", """
    select event_id, ts as at, cast(1 as bigint) as surplus from events where event_id % 50 = 0 union all
    select event_id, ts + interval 1 hour, -1 from events where event_id % 50 = 0 union all
    select event_id, ts, 1 from events where event_id % 50 = 1 union all select event_id, null, -1 from events where event_id % 50 = 1""")
def moments_compared(t: Tables) -> DataFrame:
    """Times against texts with offsets, zeros past the microsecond and other spellings. One text in fifty is an hour off,
    and one is finer than a microsecond."""
    actual = t.events.select("event_id", F.col("ts").alias("at"))
    wall = F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts"))
    there = F.date_format(wall + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 50 == 1, F.concat(there, F.lit("001+02:00"))).when(
        F.col("event_id") % 3 == 0, F.concat(there, F.lit("000+02"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.replace(there, F.lit("T"), F.lit(" ")), F.lit(" +0200 "))
    ).otherwise(F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    expected = t.events.select("event_id", moment(text).cast("timestamp_ntz").alias("at"))
    return bag_diff(actual, expected)


@query("row_count_check", "C6", """
    select 'events' as table, count(*) as rows, count(distinct event_id) as expected, count(*) = count(distinct event_id) as ok from events
    union all select 'orders', count(*), (select count(distinct l_orderkey) from lineitem), count(*) = (select count(distinct l_orderkey) from lineitem) from orders
    union all select 'months', count(distinct strftime(o_orderdate, '%Y-%m')), 12, count(distinct strftime(o_orderdate, '%Y-%m')) = 12 from orders""")
def row_count_check(t: Tables) -> DataFrame:
    """Counts of two tables and a mart beside the numbers that other tables or a rule give."""
    ids, ordered = t.events.agg(F.count_distinct("event_id")).first()[0], t.lineitem.agg(F.count_distinct("l_orderkey")).first()[0]
    months = t.orders.select(F.date_format("o_orderdate", "yyyy-MM")).distinct()
    return row_counts({"events": t.events, "orders": t.orders, "months": months}, {"events": ids, "orders": ordered, "months": 12})


def _seen_by(*results: DataFrame) -> DataFrame:
    """Each distinct result row with the number of results that hold it."""
    rows = results[0]
    for other in results[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("seen"))


@query("rerun_agreement", "C8", """
    select strftime(o_orderdate, '%Y-%m') as month, count(*) as orders, cast(sum(cast(o_totalprice as decimal(20,2))) as decimal(30,2)) as revenue, cast(2 as bigint) as seen
    from orders group by 1""")
def rerun_agreement(t: Tables) -> DataFrame:
    """Two runs of one mart over differently spread input give the same rows."""
    source = t.orders.select(
        F.lit(" DONE ").alias("status"), F.col("o_orderdate").alias("order_date"), money("o_totalprice").alias("amount")
    )
    return _seen_by(marts.monthly_revenue(source), marts.monthly_revenue(source.repartition(13)))


@query("answer_key", "C9 D1 D2", """
    with digests as (select md5('20261021-' || o_orderkey) as d from orders),
    made as (
        select strftime(date '2025-01-01' + to_months(cast(cast('0x' || substr(d, 1, 6) as bigint) % 24 as int)), '%Y-%m') as month,
               cast('0x' || substr(d, 13, 6) as bigint) % 100 as status, cast('0x' || substr(d, 19, 8) as bigint) % 999901 + 100 as cents
        from digests)
    select month, count(*) as orders, cast(sum(cents) * cast(0.01 as decimal(3,2)) as decimal(30,2)) as revenue, cast(2 as bigint) as seen
    from made where status < 70 group by 1""")
def answer_key(t: Tables) -> DataFrame:
    """The mart over made-up orders, one per order of the table, and the key worked out another way."""
    made = synth.orders_for(t.orders.select("o_orderkey"), "o_orderkey", t.orders.count())
    return _seen_by(marts.monthly_revenue(made), synth.answer_key_at_scale(made))


@query("type_audit", "C7 C10", """
    select count(*) as rows, count(distinct o_custkey) as customers, max(o_orderdate) as newest, 'UTC' as timezone,
           'o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz' as column_types from orders""")
def type_audit_query(t: Tables) -> DataFrame:
    return type_audit(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), rows=F.count(F.lit(1)),
        customers=F.count_distinct("o_custkey"), newest=F.max("o_orderdate"),
    )
