"""The named marts over the given tables, renamed to the columns each mart expects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluiceway.catalog.base import Tables, query
from sluiceway.gates import Quarantine, Unique, run_gates
from sluiceway.plans import marts


def _sql(t: Tables, text: str, *names: str) -> DataFrame:
    return t.spark.sql(text, **{n: getattr(t, n) for n in names})


# The mart inputs are plain SQL both engines read alike, so each is written once.
_PLAIN = {
    "landing_orders": """select cast(o_orderkey as string) as order_id, 'c' || o_custkey as customer,
        cast(cast(o_totalprice as decimal(20,2)) as string) as amount, cast(cast(o_orderdate as date) as string) as order_date from {orders}""",
    "landing_lines": """select cast(l_orderkey * 10 + l_linenumber as string) as order_id, 'p' || l_partkey as customer,
        cast(cast(l_extendedprice as decimal(20,2)) as string) as amount, cast(cast(l_shipdate as date) as string) as order_date from {lineitem}""",
    "partner_version": "select user_id as id, event_type as name, event_id % 4 as company_id, ts as write_date from {events}",
    "order_line": "select l_partkey as id, l_orderkey as order_id, l_suppkey as product_id, cast(l_extendedprice as decimal(20,2)) as price_subtotal from {lineitem}",
    "stg_orders": """select o_orderkey as id, o_custkey as partner_id, cast(o_totalprice as decimal(12,2)) as amount_total,
        o_custkey % 25 as currency_id, o_orderdate as write_date from {orders} where o_orderstatus <> 'F'""",
    "rates": """select o_custkey % 25 as currency_id, cast(o_orderdate as date) as rate_date,
        case when o_orderpriority = '5-LOW' then null else cast(o_totalprice as decimal(12,2)) end as rate from {orders} where o_orderstatus = 'F'""",
    "sale_order": "select o_orderkey as id, o_orderdate as write_date, cast(o_totalprice as decimal(20,2)) as amount_total from {orders}",
    "done_orders": """select o_orderkey as id, o_orderdate as order_date, cast(o_totalprice as decimal(20,2)) as amount,
        case o_orderstatus when 'F' then ' DONE ' when 'O' then 'done' else 'draft' end as status from {orders}""",
    "partner": """select c_custkey as id, case when c_custkey % 13 = 0 then '   ' when c_custkey % 17 = 0 then null
        else '  ' || c_mktsegment || c_nationkey || ' ' end as name from {customer}""",
    "excluded_partner": "select cast(c_custkey as string) as platform_id from {customer} where c_nationkey = 3",
    "price": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as detail_id,
        case when l_suppkey % 10 = 0 then null else l_suppkey end as partner_id from {lineitem}""",
    "price_partner": "select s_suppkey as id, '  ' || s_name || ' ' as name from {supplier} where s_suppkey % 7 <> 0",
    "channel": """select 'ch' || s_suppkey as Id, case when s_suppkey % 9 = 0 then '  ' else ' yt' || s_suppkey || ' ' end as YoutubeChannelId from {supplier}""",
    "channel_company": """select 'ch' || s_suppkey as ChannelId, 'co' || (s_nationkey % 3) as CompanyId,
        case when s_suppkey % 5 = 0 then true when s_suppkey % 5 = 1 then null else false end as IsDeleted from {supplier}""",
    "video": """select case when l_partkey % 31 = 0 then ' ' else ' v' || l_partkey end as YoutubeVideoId, 'yt' || l_suppkey as YoutubeChannelId,
        'f' || (l_orderkey - l_orderkey % 20) as Code, case when l_linenumber = 7 then null else l_shipdate end as PublishedAt, ' t' || l_orderkey as Title from {lineitem}""",
    "resource": """select 'r' || p_partkey as Id, case when p_size % 4 = 0 then 'oth' || p_partkey else ' stk' || (p_partkey % 900) || ' ' end as ResourceFileId,
        p_size % 2 as ResourceType from {part}""",
    "editing": "select 'e' || o_orderkey as Id, 'f' || (o_orderkey - o_orderkey % 20) as EditingFileId from {orders}",
    "resource_editing": """select 'x' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as Id, 'e' || l_orderkey as EditingId,
        'r' || l_partkey as ResourcesId, l_quantity as StartTime, l_quantity + l_discount as EndTime from {lineitem}""",
    "stock_seed": "select ' stk' || (p_partkey % 900) as stock_id from {part} where p_size = 13",
    "sla_order": """select o_orderkey as id, case o_orderstatus when 'F' then 'sale' when 'O' then 'done' else 'draft' end as state, o_orderdate as date_order,
        case when o_orderpriority = '1-URGENT' then null else o_orderdate + interval '30' day end as commitment_date from {orders}""",
    "sla_picking": """select l_orderkey as sale_id, case when l_linenumber <= 5 then 'outgoing' else 'internal' end as picking_type,
        case when l_returnflag = 'N' then 'assigned' else 'done' end as state, case when l_tax = 0 then null else l_shipdate end as date_done from {lineitem}""",
    "plan_detail": """select p_partkey as id, case when p_size % 6 = 0 then null else p_size end as plan_id, p_size * 2 as produce_manager,
        cast(null as bigint) as ar_id, case when p_size % 8 = 0 then '  ' else ' ' || p_type || ' ' end as state from {part}""",
    "song": """select p_partkey as id, case when p_size % 5 = 0 then null else p_size % 5 <> 1 end as active,
        case when p_size % 7 = 0 then '  ' else ' VN' || (p_partkey % 300) || case when p_size % 2 = 0 then ' ' else '' end end as isrc,
        case when p_size % 3 = 0 then '' else p_type end as release_state, case when p_size % 4 = 0 then null else date '2020-01-15' end as release_date,
        cast(p_size as double) as distro, case when p_size = 9 then null else cast(p_partkey % 150 as double) end as purchase_order_id from {part}""",
    "certificate": """select cast(s_suppkey as double) as purchase_order_id, case when s_suppkey % 6 = 0 then '  ' else ' https://example.org/' || s_suppkey || ' ' end as acceptance_link
        from {supplier}""",
}


def _source(t: Tables, name: str) -> DataFrame:
    text = _PLAIN[name]
    table = text[text.index("{") + 1 : text.index("}")]
    return _sql(t, text, table)


def _ctes(*names: str) -> str:
    parts = [f"{n} as ({_PLAIN[n].replace('{', '').replace('}', '')})" for n in names]
    return "with " + ",\n".join(parts)


_KEY = "md5(coalesce(cast({} as varchar), '_dbt_utils_surrogate_key_null_'))"


def _clean(c: str) -> str:
    return f"nullif(trim(cast({c} as varchar)), '')"


@query("orders_with_vat", "M1 T2 T16", _ctes("landing_orders") + """
    select cast(order_id as bigint) as order_id, customer, cast(amount as decimal(20,2)) as amount,
           cast(round(cast(amount as decimal(20,2)) * 1.10, 2) as decimal(23,2)) as amount_with_vat, cast(order_date as date) as order_date
    from landing_orders""")
def orders_with_vat(t: Tables) -> DataFrame:
    return marts.orders_with_vat(marts.raw_orders(_source(t, "landing_orders")))


@query("gated_orders_with_vat", "M1 M2 G6", _ctes("landing_lines") + """
    select cast(order_id as bigint) as order_id, customer, cast(amount as decimal(20,2)) as amount,
           cast(round(cast(amount as decimal(20,2)) * 1.10, 2) as decimal(23,2)) as amount_with_vat, cast(order_date as date) as order_date
    from landing_lines where order_id not in (select order_id from landing_lines group by 1 having count(*) > 1)""")
def gated_orders_with_vat(t: Tables) -> DataFrame:
    raw = marts.raw_orders(_source(t, "landing_lines"))
    kept = run_gates({"orders_raw": raw}, [Unique("orders_raw", ["order_id"])], Quarantine(100)).tables["orders_raw"]
    return marts.orders_with_vat(kept)


@query("staged_partners", "M3 T32", _ctes("partner_version") + """
    select id, name, company_id, write_date from (
        select *, row_number() over (partition by id order by write_date desc nulls first, name nulls last, company_id nulls last) as rn from partner_version) where rn = 1""")
def staged_partners(t: Tables) -> DataFrame:
    columns = {"id": "bigint", "name": "string", "company_id": "bigint", "write_date": "timestamp_ntz"}
    return marts.staged_latest(_source(t, "partner_version"), columns, version="write_date")


@query("staged_order_lines", "M3 T33", _ctes("order_line") + """
    select id, order_id, product_id, price_subtotal from (
        select *, row_number() over (partition by id order by order_id, product_id, price_subtotal) as rn from order_line) where rn = 1""")
def staged_order_lines(t: Tables) -> DataFrame:
    columns = {"id": "bigint", "order_id": "bigint", "product_id": "bigint", "price_subtotal": "decimal(20,2)"}
    return marts.staged_latest(_source(t, "order_line"), columns)


_CONVERTED = _ctes("stg_orders", "rates") + """,
    day_rates as (select currency_id, rate_date, max(rate) as rate from rates where rate is not null group by 1, 2),
    rated as (
        select o.id, o.partner_id, o.currency_id, o.amount_total, o.write_date, arg_max(r.rate, r.rate_date) as rate
        from stg_orders o left join day_rates r on r.currency_id = o.currency_id
             and r.rate_date between cast(o.write_date as date) - 5 and cast(o.write_date as date)
        group by 1, 2, 3, 4, 5)"""


@query("converted_sales", "M4 T31", _CONVERTED + """
    select id as order_id, partner_id, currency_id, amount_total, cast(amount_total * rate as decimal(25,4)) as converted_amount, 'USD' as reporting_currency
    from rated where rate is not null""")
def converted_sales(t: Tables) -> DataFrame:
    return marts.converted_sales(_source(t, "stg_orders"), _source(t, "rates"))


@query("unconverted_sales", "M4 T31 T49", _CONVERTED + """
    select id as order_id, currency_id, write_date,
           'no exchange rate for currency_id=' || currency_id || ' within 5 days of ' || strftime(write_date, '%Y-%m-%d') as reason
    from rated where rate is null""")
def unconverted_sales(t: Tables) -> DataFrame:
    return marts.unconverted_sales(_source(t, "stg_orders"), _source(t, "rates"))


@query("monthly_sales", "M5 T13 T38", _ctes("sale_order") + """
    select strftime(write_date, '%Y-%m') as month, cast(sum(amount_total) as decimal(30,2)) as revenue from sale_order group by 1""")
def monthly_sales(t: Tables) -> DataFrame:
    return marts.monthly_sales(_source(t, "sale_order"))


@query("monthly_revenue", "M6 T9 T13 T39", _ctes("done_orders") + """
    select strftime(order_date, '%Y-%m') as month, count(*) as orders, cast(sum(amount) as decimal(30,2)) as revenue
    from done_orders where lower(trim(status)) = 'done' group by 1""")
def monthly_revenue(t: Tables) -> DataFrame:
    return marts.monthly_revenue(_source(t, "done_orders"))


_DIM_ARTIST = f"dim_artist as (select {_KEY.format('id')} as dim_artist_sk, {_clean('id')} as platform_id, {_clean('name')} as platform_name from partner)"
_ACTIVE = "active as (select a.* from dim_artist a left join excluded_partner x on x.platform_id = a.platform_id where x.platform_id is null)"


@query("dim_artist", "M7 T8 T12", _ctes("partner") + f", {_DIM_ARTIST} select * from dim_artist")
def dim_artist(t: Tables) -> DataFrame:
    return marts.dim_artist(_source(t, "partner"))


def _active(t: Tables) -> DataFrame:
    return marts.dim_artist_active(marts.dim_artist(_source(t, "partner")), _source(t, "excluded_partner"))


@query("dim_artist_active", "M8 T30", _ctes("partner", "excluded_partner") + f", {_DIM_ARTIST}, {_ACTIVE} select * from active")
def dim_artist_active(t: Tables) -> DataFrame:
    return _active(t)


@query("artist_summary", "M9 T44", _ctes("partner", "excluded_partner") + f""", {_DIM_ARTIST}, {_ACTIVE}
    select count(*) as artists, count(distinct platform_name) as distinct_names, min(cast(platform_id as bigint)) as min_platform_id,
           max(cast(platform_id as bigint)) as max_platform_id from active""")
def artist_summary(t: Tables) -> DataFrame:
    return marts.artist_summary(_active(t))


@query("partner_summary", "M10 T19 T37 T44", _ctes("partner") + """
    select count(distinct id) as artists, count(distinct trim(name)) as distinct_names, min(id) as min_id, max(id) as max_id
    from partner where id not in (2, 4) and trim(name) <> ''""")
def partner_summary(t: Tables) -> DataFrame:
    partners = _source(t, "partner")
    return marts.partner_summary(partners.unionByName(partners), [2, 4])


@query("artist_assignment", "M11 T26", _ctes("price", "price_partner") + f"""
    select {_KEY.format('x.id')} as fact_artist_assignment_sk, {_clean('x.detail_id')} as production_plan_detail_id,
           {_clean('x.partner_id')} as artist_id, {_clean('p.name')} as artist_name
    from price x left join price_partner p on x.partner_id = p.id""")
def artist_assignment(t: Tables) -> DataFrame:
    return marts.fact_artist_assignment(_source(t, "price"), _source(t, "price_partner"))


_DIM_VIDEO = f"""
    masters as (select nullif(trim(YoutubeChannelId), '') as channel_id from channel ch where nullif(trim(YoutubeChannelId), '') is not null
                and exists (select 1 from channel_company cc where cc.ChannelId = ch.Id and coalesce(cc.IsDeleted, false) = false and cc.CompanyId = 'co1')),
    versions as (
        select v.*, row_number() over (partition by YoutubeVideoId order by PublishedAt desc nulls first, YoutubeChannelId, Code, Title) as rn
        from video v join masters m on nullif(trim(v.YoutubeChannelId), '') = m.channel_id where nullif(trim(YoutubeVideoId), '') is not null),
    dim_video as (
        select {_KEY.format('YoutubeVideoId')} as dim_video_sk, {_clean('YoutubeVideoId')} as video_id, {_clean('YoutubeChannelId')} as channel_id,
               'https://www.youtube.com/watch?v=' || YoutubeVideoId as video_url, {_clean('Code')} as editing_code,
               PublishedAt as published_date, {_clean('Title')} as video_name
        from versions where rn = 1)"""


def _videos(t: Tables) -> DataFrame:
    return marts.dim_video(_source(t, "channel"), _source(t, "channel_company"), _source(t, "video"), "co1")


@query("dim_video", "M12 T5 T8 T10 T12 T21 T22 T25 T28 T34", _ctes("channel", "channel_company", "video") + f", {_DIM_VIDEO} select * from dim_video")
def dim_video(t: Tables) -> DataFrame:
    return _videos(t)


_FACT_EDITING = f"""
    excluded as (select distinct upper(trim(stock_id)) as stock_id from stock_seed where nullif(trim(stock_id), '') is not null),
    used as (
        select distinct re.Id as resource_editing_id, re.EditingId as editing_id, e.EditingFileId as editing_code,
               upper(trim(r.ResourceFileId)) as stock_id, re.StartTime as start_time, re.EndTime as end_time
        from resource_editing re join editing e on re.EditingId = e.Id join resource r on re.ResourcesId = r.Id
        where r.ResourceType = 0 and upper(trim(r.ResourceFileId)) like 'STK%'
          and not exists (select 1 from excluded x where x.stock_id = upper(trim(r.ResourceFileId)))),
    fact_editing as (
        select {_KEY.format('resource_editing_id')} as fact_editing_sk, editing_id, editing_code, stock_id,
               row_number() over (partition by editing_id order by start_time, resource_editing_id, editing_code, stock_id, end_time) as position,
               cast(end_time as decimal(20,6)) - cast(start_time as decimal(20,6)) as duration
        from used)"""


def _editings(t: Tables) -> DataFrame:
    return marts.fact_editing(
        _source(t, "resource_editing"), _source(t, "editing"), _source(t, "resource"),
        marts.excluded_stock(_source(t, "stock_seed")), "STK",
    )


@query("excluded_stock", "M13 T9 T37 S22", _ctes("stock_seed") + """
    select distinct upper(trim(stock_id)) as stock_id from stock_seed where nullif(trim(stock_id), '') is not null""")
def excluded_stock(t: Tables) -> DataFrame:
    return marts.excluded_stock(_source(t, "stock_seed"))


@query("fact_editing", "M13 T9 T11 T15 T24 T29 T36 T37",
       _ctes("resource_editing", "editing", "resource", "stock_seed") + f", {_FACT_EDITING} select * from fact_editing")
def fact_editing(t: Tables) -> DataFrame:
    return _editings(t)


@query("resource_usage", "M14 T12 T18 T24 T37 T43",
       _ctes("channel", "channel_company", "video", "resource_editing", "editing", "resource", "stock_seed") + f", {_DIM_VIDEO}, {_FACT_EDITING}" + """,
    shown as (select distinct video_id, editing_code, published_date from dim_video
              where published_date is not null and video_id is not null and editing_code is not null),
    pairs as (select s.video_id, s.published_date, f.stock_id, min(f.position) as first_position
              from shown s join fact_editing f on f.editing_code = s.editing_code group by 1, 2, 3)
    select md5(video_id || '-' || stock_id) as resource_video_sk, video_id, stock_id, published_date, first_position,
           case when first_position = 1 then '1' when first_position between 2 and 3 then '2-3'
                when first_position between 4 and 5 then '4-5' when first_position > 5 then '>5' end as position_group
    from pairs""")
def resource_usage(t: Tables) -> DataFrame:
    return marts.resource_usage(_videos(t), _editings(t))


@query("delivery_sla", "M15 T14 T17 T19 T40 T41 T42", _ctes("sla_order", "sla_picking") + """,
    eligible as (select id, date_order, coalesce(commitment_date, date_order + interval 72 hour) as due from sla_order where state in ('sale', 'done')),
    first_delivery as (select sale_id, min(date_done) as delivered_at from sla_picking
                       where picking_type = 'outgoing' and state = 'done' and sale_id is not null and date_done is not null group by 1)
    select strftime(date_order, '%Y-%m') as month, count(*) as eligible_orders, count(delivered_at) as delivered_orders,
           count(*) filter (where delivered_at <= due) as on_time_orders,
           cast(round(100.0 * count(*) filter (where delivered_at <= due) / count(*), 1) as decimal(5,1)) as on_time_rate
    from eligible left join first_delivery on sale_id = id group by 1""")
def delivery_sla(t: Tables) -> DataFrame:
    return marts.delivery_sla(_source(t, "sla_order"), _source(t, "sla_picking"))


@query("plan_detail", "M16 T7 T8 T12", _ctes("plan_detail") + f"""
    select {_KEY.format('id')} as fact_plan_detail_sk, {_clean('id')} as production_plan_detail_id, {_clean('plan_id')} as production_plan_id,
           {_clean('produce_manager')} as production_manager, {_clean('ar_id')} as ar_manager, {_clean('state')} as status from plan_detail""")
def plan_detail(t: Tables) -> DataFrame:
    return marts.fact_plan_detail(_source(t, "plan_detail"))


@query("label_operation", "M17 T6 T12 T20 T23 T27 T35 G6", _ctes("song", "certificate") + f""",
    ranked as (select s.*, c.acceptance_link, row_number() over (partition by s.isrc order by s.id) as rn
               from song s left join certificate c on cast(c.purchase_order_id as bigint) = cast(s.purchase_order_id as bigint)
               where s.active is true and nullif(trim(s.isrc), '') is not null)
    select {_KEY.format('id')} as fact_label_operation_sk, {_clean('id')} as resource_id, {_clean('release_state')} as release_status,
           cast(release_date as timestamp) as release_date, {_clean('acceptance_link')} as acceptance_url, {_clean('isrc')} as isrc,
           cast(cast(distro as bigint) as varchar) as distributor
    from ranked where rn = 1""")
def label_operation(t: Tables) -> DataFrame:
    """Behind the gate that no order has two certificates; there is no quarantine, so a second one stops the run."""
    certificates = _source(t, "certificate")
    outcome = run_gates({"certificates": certificates}, [Unique("certificates", ["purchase_order_id"])])
    if not outcome.passed:
        raise ValueError("; ".join(outcome.failures))
    return marts.fact_label_operation(_source(t, "song"), certificates)
