"""Named marts: each is one function from source tables to a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions import (
    asc, clean, desc, due_at, duration, in_set, integral_text, is_live, is_strictly_true, lower_clean, money,
    not_blank, not_in_set, percentage, range_label, reason, starts_with, surrogate_key, upper_clean,
    wall_clock, with_rate,
)
from sluiceway.operators import aggregate, dedupe, joins
from sluiceway.operators.asof import with_asof
from sluiceway.operators.ranking import position_in_group

# Fixed values of the marts.
VAT_FACTOR = "1.10"
DONE = "done"
REPORTING_CURRENCY = "USD"
RATE_LOOKBACK_DAYS = 5
VIDEO_URL = "https://www.youtube.com/watch?v="
POSITION_GROUPS = ((1, 1, "1"), (2, 3, "2-3"), (4, 5, "4-5"), (6, None, ">5"))
ELIGIBLE_STATES = ("sale", "done")
DELIVERY_TYPE = "outgoing"
DELIVERY_STATE = "done"
PROMISE_HOURS = 72


# ---- orders

def raw_orders(landing: DataFrame) -> DataFrame:
    """Text landing columns as typed ones; a bad value raises."""
    return landing.select(
        F.col("order_id").cast("bigint").alias("order_id"), "customer",
        money("amount").alias("amount"), F.col("order_date").cast("date").alias("order_date"),
    )


def orders_with_vat(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id", "customer", "amount", with_rate("amount", VAT_FACTOR).alias("amount_with_vat"), "order_date"
    )


def staged_latest(table: DataFrame, columns: dict[str, str], key: str = "id", version: str | None = None) -> DataFrame:
    """Cast columns and one row per key: the newest by `version`, or any one (the smallest) without it."""
    typed = table.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])
    if version is None:
        return dedupe.keep_one(typed, [key])
    rest = [asc(c) for c in columns if c not in (key, version)]
    return dedupe.keep_first(typed, [key], [desc(version), *rest])


def _with_rates(orders: DataFrame, rates: DataFrame) -> DataFrame:
    return with_asof(orders, rates, ["currency_id"], "write_date", "rate_date", "rate", RATE_LOOKBACK_DAYS)


def converted_sales(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Sales in the reporting currency, at the latest rate on or up to five days before the order."""
    return _with_rates(orders, rates).where("rate is not null").select(
        F.col("id").alias("order_id"), "partner_id", "currency_id", "amount_total",
        (F.col("amount_total") * F.col("rate")).alias("converted_amount"),
        F.lit(REPORTING_CURRENCY).alias("reporting_currency"),
    )


def unconverted_sales(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Sales without a usable rate, with the reason."""
    return _with_rates(orders, rates).where("rate is null").select(
        F.col("id").alias("order_id"), "currency_id", "write_date",
        reason(
            f"no exchange rate for currency_id=%s within {RATE_LOOKBACK_DAYS} days of %s",
            "currency_id", F.col("write_date").cast("date"),
        ).alias("reason"),
    )


def monthly_sales(orders: DataFrame) -> DataFrame:
    return aggregate.by_month(orders, "write_date", F.sum(money("amount_total")).alias("revenue"))


def monthly_revenue(orders: DataFrame) -> DataFrame:
    """Count and revenue of completed orders by month; months without one have no row."""
    done = orders.where(lower_clean("status") == DONE)
    return aggregate.by_month(
        done, "order_date", F.count(F.lit(1)).alias("orders"), F.sum(money("amount")).alias("revenue")
    )


# ---- artists

def dim_artist(partners: DataFrame) -> DataFrame:
    return partners.select(
        surrogate_key("id").alias("dim_artist_sk"), clean("id").alias("platform_id"), clean("name").alias("platform_name")
    )


def dim_artist_active(artists: DataFrame, excluded: DataFrame) -> DataFrame:
    return joins.without_listed(artists, excluded, F.col("platform_id"), "platform_id")


def artist_summary(active: DataFrame) -> DataFrame:
    return aggregate.one_row_summary(
        active, "*", "platform_name", F.col("platform_id").cast("bigint"),
        ["artists", "distinct_names", "min_platform_id", "max_platform_id"],
    )


def partner_summary(partners: DataFrame, excluded_ids: list[int]) -> DataFrame:
    """Summary over named partners: names trimmed, blanks left out, an id counted once, case kept."""
    named = partners.where(not_in_set("id", excluded_ids) & not_blank("name")).select("id", F.trim("name").alias("name"))
    return aggregate.one_row_summary(
        dedupe.collapse_copies(named), "id", "name", F.col("id"), ["artists", "distinct_names", "min_id", "max_id"]
    )


def fact_artist_assignment(prices: DataFrame, partners: DataFrame) -> DataFrame:
    """One row per price line; the artist's name is NULL when the partner is unknown."""
    named = joins.enrich(prices, partners, F.col("partner_id"), partners["id"], ["name"])
    return named.select(
        surrogate_key("id").alias("fact_artist_assignment_sk"), clean("detail_id").alias("production_plan_detail_id"),
        clean("partner_id").alias("artist_id"), clean("name").alias("artist_name"),
    )


# ---- resource usage

def dim_video(channels: DataFrame, channel_companies: DataFrame, videos: DataFrame, company_id: str) -> DataFrame:
    """Newest version of each video of the company's channels. Versions group by the raw id; only output is trimmed."""
    owned = channel_companies.where(is_live("IsDeleted") & (F.col("CompanyId") == F.lit(company_id)))
    ours = joins.having_match(channels, owned, "Id", "ChannelId").where(not_blank("YoutubeChannelId"))
    # One channel listed twice would only repeat versions that the next step drops, so list it once.
    ids = ours.select(clean("YoutubeChannelId").alias("_channel")).distinct()
    known = videos.where(not_blank("YoutubeVideoId")).join(
        ids, clean("YoutubeChannelId") == F.col("_channel"), "left_semi"
    )
    rest = [asc(c) for c in videos.columns if c not in ("YoutubeVideoId", "PublishedAt")]
    newest = dedupe.keep_first(known, ["YoutubeVideoId"], [desc("PublishedAt"), *rest])
    return newest.select(
        surrogate_key("YoutubeVideoId").alias("dim_video_sk"), clean("YoutubeVideoId").alias("video_id"),
        clean("YoutubeChannelId").alias("channel_id"), F.concat(F.lit(VIDEO_URL), "YoutubeVideoId").alias("video_url"),
        clean("Code").alias("editing_code"), wall_clock("PublishedAt").alias("published_date"),
        clean("Title").alias("video_name"),
    )


def excluded_stock(seed: DataFrame, column: str = "stock_id") -> DataFrame:
    return seed.where(not_blank(column)).select(upper_clean(column).alias("stock_id")).distinct()


def fact_editing(
    resource_editings: DataFrame, editings: DataFrame, resources: DataFrame, excluded: DataFrame, code_prefix: str
) -> DataFrame:
    """Stock resources used in an editing with their position. Excluded ones take no position."""
    stock = resources.where((F.col("ResourceType") == 0)).select(
        F.col("Id").alias("ResourcesId"), upper_clean("ResourceFileId").alias("stock_id")
    ).where(starts_with("stock_id", code_prefix))
    stock = joins.without_listed(stock, excluded, F.col("stock_id"), "stock_id")
    codes = editings.select(F.col("Id").alias("EditingId"), F.col("EditingFileId").alias("editing_code"))
    used = resource_editings.join(codes, "EditingId").join(stock, "ResourcesId")
    rows = used.select(
        F.col("Id").alias("resource_editing_id"), F.col("EditingId").alias("editing_id"), "editing_code", "stock_id",
        F.col("StartTime").alias("start_time"), F.col("EndTime").alias("end_time"),
    ).distinct()
    # Ties beyond start time and id are conflicting copies; the unique test on the key reports them.
    order = [asc(c) for c in ("start_time", "resource_editing_id", "editing_code", "stock_id", "end_time")]
    uses = resource_editings.select(F.col("EditingId").alias("editing_id"))
    return position_in_group(rows, ["editing_id"], order, sized_by=uses).select(
        surrogate_key("resource_editing_id").alias("fact_editing_sk"), "editing_id", "editing_code", "stock_id",
        "position", duration("start_time", "end_time").alias("duration"),
    )


def resource_usage(videos: DataFrame, editings: DataFrame) -> DataFrame:
    """First position of each stock resource in each published video. The date groups but is not in the key."""
    published = videos.where("published_date is not null and video_id is not null and editing_code is not null")
    shown = published.select("video_id", "editing_code", "published_date").distinct()
    # One position per editing and resource first: the join then carries no repeated uses.
    first = editings.where("stock_id is not null").groupBy("editing_code", "stock_id").agg(F.min("position").alias("position"))
    pairs = shown.join(first, "editing_code").groupBy("video_id", "published_date", "stock_id").agg(
        F.min("position").alias("first_position")
    )
    return pairs.select(
        surrogate_key("video_id", "stock_id").alias("resource_video_sk"), "video_id", "stock_id", "published_date",
        "first_position", range_label("first_position", POSITION_GROUPS).alias("position_group"),
    )


# ---- deliveries

def delivery_sla(orders: DataFrame, pickings: DataFrame) -> DataFrame:
    """Eligible, delivered and on-time orders by order month. The first delivery decides; the due time is inclusive."""
    eligible = orders.where(in_set("state", ELIGIBLE_STATES)).select(
        "id", "date_order", due_at("commitment_date", "date_order", PROMISE_HOURS).alias("due")
    )
    deliveries = pickings.where((F.col("picking_type") == DELIVERY_TYPE) & (F.col("state") == DELIVERY_STATE))
    first = aggregate.first_event(deliveries, "sale_id", "date_done", "delivered_at")
    joined = eligible.join(first, F.col("id") == F.col("sale_id"), "left")
    on_time = F.count_if(F.col("delivered_at") <= F.col("due"))
    return aggregate.by_month(
        joined, "date_order", F.count(F.lit(1)).alias("eligible_orders"), F.count("delivered_at").alias("delivered_orders"),
        on_time.alias("on_time_orders"), percentage(on_time, F.count(F.lit(1))).alias("on_time_rate"),
    )


# ---- production and label facts

def fact_plan_detail(details: DataFrame) -> DataFrame:
    """One row per production-plan detail, six text columns."""
    return details.select(
        surrogate_key("id").alias("fact_plan_detail_sk"), clean("id").alias("production_plan_detail_id"),
        clean("plan_id").alias("production_plan_id"), clean("produce_manager").alias("production_manager"),
        clean("ar_id").alias("ar_manager"), clean("state").alias("status"),
    )


def fact_label_operation(songs: DataFrame, certificates: DataFrame) -> DataFrame:
    """Per raw recording code, the active song with the smallest id and its certificate.

    Gate certificates as unique on the purchase order first: a second certificate must stop the run.
    """
    kept = dedupe.keep_first(songs.where(is_strictly_true("active") & not_blank("isrc")), ["isrc"], [asc("id")])
    linked = joins.enrich(
        kept, certificates, F.col("purchase_order_id").cast("bigint"),
        certificates["purchase_order_id"].cast("bigint"), ["acceptance_link"],
    )
    return linked.select(
        surrogate_key("id").alias("fact_label_operation_sk"), clean("id").alias("resource_id"),
        clean("release_state").alias("release_status"), F.col("release_date").cast("timestamp_ntz").alias("release_date"),
        clean("acceptance_link").alias("acceptance_url"), clean("isrc").alias("isrc"),
        clean(integral_text("distro")).alias("distributor"),
    )
