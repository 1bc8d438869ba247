"""Projections, scalars, filters, joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.catalog.base import Tables, query
from sluiceway.functions import (
    asc, blank_to_null, clean, desc, due_at, duration, in_set, integral_text, is_live, is_strictly_true, joined,
    lower_clean, money, month_key, not_blank, not_in_set, percentage, range_label, reason, starts_with,
    surrogate_key, upper_clean, wall_clock, with_rate,
)
from sluiceway.operators import aggregate, dedupe, joins
from sluiceway.operators.asof import with_asof
from sluiceway.operators.ranking import position_in_group
from sluiceway.plans.staged import build_models


# ---- projections and casts

@query("typed_projection", "T1 T4 T7", """
    select l_orderkey as order_id, cast(l_linenumber as smallint) as line, cast(l_quantity as bigint) as quantity,
           cast(l_extendedprice as decimal(20,2)) as price, cast(l_shipdate as date) as shipped
    from lineitem""")
def typed_projection(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("smallint").alias("line"),
        F.col("l_quantity").cast("bigint").alias("quantity"), money("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("shipped"),
    )


@query("text_to_typed", "T2 T3", """
    with landing as (
        select cast(o_orderkey as varchar) as order_id, strftime(o_orderdate, '%Y-%m-%d') as order_date,
               case when o_orderpriority = '5-LOW' then '' else cast(cast(o_totalprice as decimal(20,2)) as varchar) end as amount
        from orders)
    select cast(order_id as bigint) as order_id, cast(order_date as date) as order_date,
           cast(nullif(amount, '') as decimal(20,2)) as amount
    from landing""")
def text_to_typed(t: Tables) -> DataFrame:
    landing = t.orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(money("o_totalprice").cast("string")).alias("amount"),
    )
    return landing.select(
        F.col("order_id").cast("bigint").alias("order_id"), F.col("order_date").cast("date").alias("order_date"),
        money(blank_to_null("amount")).alias("amount"),
    )


@query("instant_to_wall_clock", "T5", "select event_id, ts as wall_time from events")
def instant_to_wall_clock(t: Tables) -> DataFrame:
    instants = t.events.select("event_id", F.col("ts").cast("timestamp").alias("instant"))
    return instants.select("event_id", wall_clock("instant").alias("wall_time"))


@query("integral_text", "T6", """
    select l_orderkey, l_linenumber,
           case when l_quantity = floor(l_quantity) then cast(cast(l_quantity as bigint) as varchar)
                else cast(l_quantity as varchar) end as quantity,
           case when l_discount = floor(l_discount) then cast(cast(l_discount as bigint) as varchar)
                else cast(l_discount as varchar) end as discount
    from lineitem""")
def integral_text_query(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", integral_text("l_quantity").alias("quantity"), integral_text("l_discount").alias("discount")
    )


# ---- strings

@query("trim_to_null", "T8", """
    select p_partkey, nullif(trim(case when p_size % 5 = 0 then '   ' else '  ' || p_name || ' ' end), '') as part_name
    from part""")
def trim_to_null(t: Tables) -> DataFrame:
    padded = F.when(F.col("p_size") % 5 == 0, "   ").otherwise(joined(F.lit("  "), F.col("p_name"), F.lit(" ")))
    return t.part.select("p_partkey", clean(padded).alias("part_name"))


@query("normalise_status", "T9", """
    select c_custkey, lower(trim(' ' || c_mktsegment || '  ')) as segment, upper(trim(' ' || c_name)) as code from customer""")
def normalise_status(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", lower_clean(joined(F.lit(" "), F.col("c_mktsegment"), F.lit("  "))).alias("segment"),
        upper_clean(joined(F.lit(" "), F.col("c_name"))).alias("code"),
    )


@query("joined_url", "T10", """
    select s_suppkey, 'https://example.org/supplier?id=' || s_suppkey || '&name=' || s_name as url from supplier""")
def joined_url(t: Tables) -> DataFrame:
    url = joined(F.lit("https://example.org/supplier?id="), F.col("s_suppkey").cast("string"), F.lit("&name="), F.col("s_name"))
    return t.supplier.select("s_suppkey", url.alias("url"))


@query("prefix_match", "T11", "select p_partkey, p_name from part where p_name like 'small%'")
def prefix_match(t: Tables) -> DataFrame:
    return t.part.where(starts_with("p_name", "small")).select("p_partkey", "p_name")


@query("surrogate_key", "T12", """
    select distinct l_orderkey, l_linenumber,
           md5(concat_ws('-', cast(l_orderkey as varchar),
                         coalesce(cast(nullif(l_linenumber, 7) as varchar), '_dbt_utils_surrogate_key_null_'))) as line_sk
    from lineitem""")
def surrogate_key_query(t: Tables) -> DataFrame:
    line = F.nullif(F.col("l_linenumber"), F.lit(7))
    keys = dedupe.collapse_copies(t.lineitem, ["l_orderkey", "l_linenumber"])
    return keys.withColumn("line_sk", surrogate_key("l_orderkey", line))


# ---- dates, numbers, conditions

@query("default_due", "T14", """
    select o_orderkey, coalesce(case when o_orderpriority = '1-URGENT' then null else o_orderdate + interval 5 day end,
                                o_orderdate + interval 72 hour) as due
    from orders""")
def default_due(t: Tables) -> DataFrame:
    promised = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate") + F.expr("interval 5 days"))
    return t.orders.select("o_orderkey", due_at(promised, "o_orderdate", 72).alias("due"))


@query("numeric_difference", "T15", """
    select l_orderkey, l_linenumber, cast(l_quantity as decimal(20,6)) - cast(l_discount as decimal(20,6)) as difference from lineitem""")
def numeric_difference(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", duration("l_discount", "l_quantity").alias("difference"))


@query("rounded_amount", "T16", """
    select o_orderkey, cast(round(cast(o_totalprice as decimal(20,2)) * cast(1.10 as decimal(3,2)), 2) as decimal(23,2)) as amount_with_vat from orders""")
def rounded_amount(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", with_rate(money("o_totalprice"), "1.10").alias("amount_with_vat"))


@query("percentage_share", "T17 T40", """
    select o_orderpriority, count(*) as orders, count(*) filter (where o_orderstatus = 'F') as finished,
           cast(round(100.0 * count(*) filter (where o_orderstatus = 'F') / count(*), 1) as decimal(5,1)) as finished_pct
    from orders group by o_orderpriority""")
def percentage_share(t: Tables) -> DataFrame:
    finished = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), finished.alias("finished"),
        percentage(finished, F.count(F.lit(1))).alias("finished_pct"),
    )


@query("bucket_label", "T18", """
    select l_orderkey, l_linenumber, l_quantity,
           case when l_quantity between 0 and 10 then 'low' when l_quantity between 11 and 30 then 'middle'
                when l_quantity > 30 then 'high' end as bucket
    from lineitem""")
def bucket_label(t: Tables) -> DataFrame:
    label = range_label("l_quantity", ((0, 10, "low"), (11, 30, "middle"), (30, None, "high")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", label.alias("bucket"))


# ---- filters

@query("value_in_set", "T19", """
    select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('5-LOW', '1-URGENT')""")
def value_in_set(t: Tables) -> DataFrame:
    kept = in_set("o_orderstatus", ["F", "P"]) & not_in_set("o_orderpriority", ["5-LOW", "1-URGENT"])
    return t.orders.where(kept).select("o_orderkey", "o_orderstatus")


@query("strictly_true", "T20", """
    select c_custkey from customer where (case when c_nationkey % 4 = 0 then null else c_acctbal > 0 end) is true""")
def strictly_true(t: Tables) -> DataFrame:
    active = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal") > 0)
    return t.customer.where(is_strictly_true(active)).select("c_custkey")


@query("soft_delete", "T21", """
    select c_custkey from customer where coalesce(case when c_nationkey % 4 = 0 then null else c_acctbal > 0 end, false) = false""")
def soft_delete(t: Tables) -> DataFrame:
    deleted = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal") > 0)
    return t.customer.where(is_live(deleted)).select("c_custkey")


@query("parameter_filter", "T22", "select o_orderkey, o_custkey from orders where o_orderpriority = '2-HIGH'")
def parameter_filter(t: Tables) -> DataFrame:
    return t.spark.sql(
        "select o_orderkey, o_custkey from {orders} where o_orderpriority = :priority",
        args={"priority": "2-HIGH"}, orders=t.orders,
    )


@query("non_blank", "T23", """
    select p_partkey from part where nullif(trim(case when p_size % 3 = 0 then '  ' when p_size % 3 = 1 then null else p_name end), '') is not null""")
def non_blank(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 2, F.col("p_name"))
    return t.part.where(not_blank(name)).select("p_partkey")


# ---- joins

@query("inner_join", "T24", """
    select l_orderkey, l_linenumber, o_custkey, l_quantity from lineitem join orders on l_orderkey = o_orderkey""")
def inner_join(t: Tables) -> DataFrame:
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return joins.inner_on(t.lineitem, owners, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey", "l_quantity")


@query("inner_cast_join", "T25 T27", """
    with labels_text as (select ' ' || cast(doc_id as varchar) || '  ' as doc, quality from labels)
    select d.doc_id, d.lang, l.quality from documents d join labels_text l on cast(d.doc_id as varchar) = nullif(trim(l.doc), '')""")
def inner_cast_join(t: Tables) -> DataFrame:
    padded = t.labels.select(joined(F.lit(" "), F.col("doc_id").cast("string"), F.lit("  ")).alias("doc"), "quality")
    docs = t.documents.select("doc_id", "lang")
    return joins.inner_on_clean(docs, padded, F.col("doc_id").cast("string"), clean("doc")).select("doc_id", "lang", "quality")


@query("left_enrich", "T26 T41", """
    select c.c_custkey, c.c_name, n.n_name from customer c left join (select * from nation where n_regionkey < 3) n on c.c_nationkey = n.n_nationkey""")
def left_enrich(t: Tables) -> DataFrame:
    some = t.nation.where("n_regionkey < 3")
    rows = joins.enrich(t.customer, some, F.col("c_nationkey"), some["n_nationkey"], ["n_name"])
    return rows.select("c_custkey", "c_name", "n_name")


@query("semi_join", "T28", """
    select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def semi_join(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 400000")
    return joins.having_match(t.customer, large, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("anti_join", "T29", """
    select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def anti_join(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 400000")
    return joins.lacking_match(t.customer, large, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("listed_exclusion", "T30 S22", """
    select p.p_partkey, p.p_name from part p
    left join (select distinct l_partkey from lineitem where l_quantity > 49) x on x.l_partkey = p.p_partkey where x.l_partkey is null""")
def listed_exclusion(t: Tables) -> DataFrame:
    listed = t.lineitem.where("l_quantity > 49")
    return joins.without_listed(t.part, listed, F.col("p_partkey"), "l_partkey").select("p_partkey", "p_name")


def _rated_orders(t: Tables) -> DataFrame:
    currency = (F.col("o_custkey") % 25).alias("currency_id")
    rates = t.orders.where("o_orderstatus = 'F'").select(
        currency, F.col("o_orderdate").cast("date").alias("rate_date"),
        money("o_totalprice").alias("rate"),
    )
    placed = t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", currency, F.col("o_orderdate").cast("date").alias("order_date"))
    return with_asof(placed, rates, ["currency_id"], "order_date", "rate_date", "rate", 5)


_RATED = """
    with rates as (
        select o_custkey % 25 as currency_id, cast(o_orderdate as date) as rate_date,
               max(cast(o_totalprice as decimal(20,2))) as rate
        from orders where o_orderstatus = 'F' group by 1, 2),
    placed as (
        select o_orderkey, o_custkey % 25 as currency_id, cast(o_orderdate as date) as order_date from orders where o_orderstatus <> 'F'),
    rated as (
        select p.o_orderkey, p.currency_id, p.order_date, max(r.rate_date) as rate_date, arg_max(r.rate, r.rate_date) as rate
        from placed p left join rates r on r.currency_id = p.currency_id and r.rate_date between p.order_date - 5 and p.order_date
        group by 1, 2, 3)"""


@query("asof_rate", "T31", _RATED + " select o_orderkey, currency_id, order_date, rate_date, rate from rated where rate is not null")
def asof_rate(t: Tables) -> DataFrame:
    return _rated_orders(t).where("rate is not null").select("o_orderkey", "currency_id", "order_date", "rate_date", "rate")


@query("asof_unmatched", "T31 T49", _RATED + """
    select o_orderkey, 'no exchange rate for currency_id=' || currency_id || ' within 5 days of ' || strftime(order_date, '%Y-%m-%d') as reason
    from rated where rate is null""")
def asof_unmatched(t: Tables) -> DataFrame:
    text = reason("no exchange rate for currency_id=%s within 5 days of %s", "currency_id", "order_date")
    return _rated_orders(t).where("rate is null").select("o_orderkey", text.alias("reason"))


# ---- dedupe and windows

@query("dedupe_latest", "T32 T34", """
    select user_id, event_id, moment from (
        select user_id, event_id, case when event_type = 'error' and value < 1 then null else ts end as moment,
               row_number() over (partition by user_id order by case when event_type = 'error' and value < 1 then null else ts end desc nulls first, event_id) as rn
        from events) where rn = 1""")
def dedupe_latest(t: Tables) -> DataFrame:
    moment = F.when((F.col("event_type") == "error") & (F.col("value") < 1), None).otherwise(F.col("ts"))
    rows = t.events.select("user_id", "event_id", moment.alias("moment"))
    return dedupe.keep_first(rows, ["user_id"], [desc("moment"), asc("event_id")])


@query("dedupe_any", "T33", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
        select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey nulls last, l_suppkey nulls last, l_quantity nulls last) as rn
        from lineitem) where rn = 1""")
def dedupe_any(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dedupe.keep_one(rows, ["l_orderkey", "l_linenumber"])


@query("dedupe_smallest_id", "T35 T13", """
    select o_custkey, strftime(o_orderdate, '%Y-%m') as month, min(o_orderkey) as o_orderkey from orders where o_orderstatus <> 'P' group by 1, 2""")
def dedupe_smallest_id(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus <> 'P'").select("o_custkey", month_key("o_orderdate").alias("month"), "o_orderkey")
    return dedupe.keep_first(rows, ["o_custkey", "month"], [asc("o_orderkey")])


_POSITION_SQL = """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as position
    from lineitem"""
_LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "position")


@query("position_in_group", "T36", _POSITION_SQL)
def position_in_group_query(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", *_LINE_ORDER)
    return position_in_group(rows, ["l_orderkey"], [asc(c) for c in _LINE_ORDER]).select(*_LINE_COLUMNS)


@query("position_in_hot_group", "T36", """
    select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           row_number() over (partition by l_returnflag order by l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as position
    from lineitem""")
def position_in_hot_group(t: Tables) -> DataFrame:
    """Three groups hold the whole table, so with this bound every one is numbered in ranges."""
    rows = t.lineitem.select("l_returnflag", "l_orderkey", *_LINE_ORDER)
    order = [asc(c) for c in ("l_orderkey", *_LINE_ORDER)]
    return position_in_group(rows, ["l_returnflag"], order, rows_per_task=1000).select("l_returnflag", *_LINE_COLUMNS)


@query("distinct_rows", "T37", "select distinct l_partkey, l_suppkey from lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return dedupe.collapse_copies(t.lineitem, ["l_partkey", "l_suppkey"])


# ---- aggregates

@query("first_event", "T42", """
    select l_orderkey, min(l_shipdate) as first_shipped from lineitem where l_linestatus = 'F' group by 1""")
def first_event(t: Tables) -> DataFrame:
    return aggregate.first_event(t.lineitem.where("l_linestatus = 'F'"), "l_orderkey", "l_shipdate", "first_shipped")


@query("smallest_position", "T43", "select l_partkey, l_suppkey, min(l_linenumber) as first_line from lineitem group by 1, 2")
def smallest_position(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"))


@query("global_summary", "T44", """
    select count(*) as orders, count(distinct o_custkey) as customers, min(o_orderdate) as first_order, max(o_orderdate) as last_order from orders""")
def global_summary(t: Tables) -> DataFrame:
    return aggregate.one_row_summary(
        t.orders, "*", "o_custkey", F.col("o_orderdate"), ["orders", "customers", "first_order", "last_order"]
    )


@query("mixed_values", "T45", "select l_orderkey from lineitem group by l_orderkey having count(distinct l_returnflag) > 1")
def mixed_values(t: Tables) -> DataFrame:
    return aggregate.mixed_values(t.lineitem, "l_orderkey", "l_returnflag")


@query("ordered_concat", "T47", """
    select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as order_keys from orders group by 1""")
def ordered_concat(t: Tables) -> DataFrame:
    return aggregate.ordered_concat(t.orders, ["o_custkey"], F.col("o_orderkey"), ["o_orderkey"], "order_keys")


@query("ordered_concat_hot", "T47", """
    select l_suppkey, string_agg(cast(l_orderkey * 10 + l_linenumber as varchar), ',' order by l_orderkey, l_linenumber, l_partkey) as line_keys
    from lineitem group by 1""")
def ordered_concat_hot(t: Tables) -> DataFrame:
    """A supplier's lines do not grow with the table; with this bound every supplier is joined in pieces."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return aggregate.ordered_concat(
        t.lineitem, ["l_suppkey"], line, ["l_orderkey", "l_linenumber", "l_partkey"], "line_keys", rows_per_task=100
    )


@query("json_documents", "T48", """
    select o_custkey, '[' || string_agg(cast(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'late': nullif(o_orderpriority, '5-LOW')}) as varchar), ',' order by o_orderkey) || ']' as orders
    from orders group by 1""")
def json_documents(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("late", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return aggregate.json_documents(rows, ["o_custkey"], ["o_orderkey", "o_orderstatus", "late"], ["o_orderkey"], "orders")


@query("union_rows", "T50", """
    select o_orderkey as key, o_orderstatus as kind from orders
    union all select l_orderkey, l_linestatus from lineitem""")
def union_rows(t: Tables) -> DataFrame:
    """Two whole tables, whose rows occur many times over."""
    orders = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("kind"))
    return orders.unionByName(t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("kind")))


@query("user_models", "T46", """
    with cleaned as (select o_orderkey, o_custkey, cast(o_totalprice as decimal(20,2)) as amount from orders where o_orderstatus = 'F'),
    per_customer as (select o_custkey, count(*) as orders, sum(amount) as amount from cleaned group by 1)
    select n_name, count(*) as customers, cast(sum(p.amount) as decimal(38,2)) as amount
    from per_customer p join customer on c_custkey = p.o_custkey join nation on n_nationkey = c_nationkey group by 1""")
def user_models(t: Tables) -> DataFrame:
    """Three models, two as functions and one as SQL, that refer to each other by name."""
    built = build_models(
        {"orders": t.orders, "customer": t.customer, "nation": t.nation},
        {
            "cleaned": lambda m: m["orders"].where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", money("o_totalprice").alias("amount")),
            "per_customer": "select o_custkey, count(*) as orders, sum(amount) as amount from {cleaned} group by 1",
            "by_nation": lambda m: m["per_customer"]
            .join(m["customer"], F.col("o_custkey") == F.col("c_custkey"))
            .join(m["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum("amount").cast("decimal(38,2)").alias("amount")),
        },
    )
    return built["by_nation"]
