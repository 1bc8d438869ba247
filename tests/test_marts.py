"""Each mart on small hand-made tables with hand-made results, and wrong readings that must change them."""

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sluiceway.gates import Quarantine, Unique, run_gates
from sluiceway.operators.compare import compare_expected
from sluiceway.plans import marts


def md5(*parts):
    return hashlib.md5("-".join(parts).encode()).hexdigest()


def test_monthly_revenue(table):
    orders = table(
        {"id": "bigint", "order_date": "date", "status": "string", "amount": "decimal(20,2)"},
        (1, "2026-01-05", "done", "100.25"), (2, "2026-01-31", " DONE ", "50.50"), (3, "2026-01-09", "cancelled", "9"),
        (4, "2026-02-01", "Done", "7.10"), (5, "2026-03-01", "draft", "70"), (6, "2026-02-02", None, "1"),
    )
    assert compare_expected(marts.monthly_revenue(orders), [
        {"month": "2026-01", "orders": 2, "revenue": "150.75"}, {"month": "2026-02", "orders": 1, "revenue": "7.10"},
    ], row_count=2).ok


def test_monthly_sales(table):
    orders = table({"id": "int", "write_date": "timestamp_ntz", "amount_total": "decimal(20,2)"},
                   (1, "2026-01-31T23:59:59", "300.50"), (2, "2026-01-01T00:00:00", "50"), (3, "2026-02-01T00:00:00", "75.25"))
    assert rows(marts.monthly_sales(orders)) == [("2026-01", Decimal("350.50")), ("2026-02", Decimal("75.25"))]


def test_vat_behind_the_unique_gate(table):
    """Four of five rows share an id: 80 % is over 25 %, so the stage fails. Two of ten is 20 %: eight go on."""
    columns = {"order_id": "string", "customer": "string", "amount": "string", "order_date": "string"}
    gate = [Unique("orders_raw", ["order_id"])]
    bad = table(columns, *[("1", "a", "1.00", "2026-01-01")] * 4, ("2", "b", "2.00", "2026-01-02"))
    assert not run_gates({"orders_raw": marts.raw_orders(bad)}, gate, Quarantine(25)).passed
    good = table(columns, *[(str(i if i != 9 else 2), "c", f"{i}.05", "2026-01-01") for i in range(10)])
    out = run_gates({"orders_raw": marts.raw_orders(good)}, gate, Quarantine(25))
    assert out.passed and out.tables["orders_raw"].count() == 8 and out.rejected["orders_raw"].count() == 2
    assert rows(marts.orders_with_vat(out.tables["orders_raw"]), "order_id", "amount_with_vat")[1] == (1, Decimal("1.16"))


def test_bad_landing_text_raises(table):
    columns = {"order_id": "string", "customer": "string", "amount": "string", "order_date": "string"}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        marts.raw_orders(table(columns, ("x1", "a", "1", "2026-01-01"))).collect()


ORDERS = {"id": "bigint", "partner_id": "bigint", "amount_total": "decimal(12,2)", "currency_id": "bigint", "write_date": "timestamp_ntz"}
RATES = {"currency_id": "bigint", "rate_date": "date", "rate": "decimal(12,4)"}


def test_converted_sales(table):
    orders = table(
        ORDERS, (1, 9, "10", 3, "2026-01-10T08:00:00"), (2, 9, "10", 3, "2026-01-15T23:59:59"), (3, 9, "10", 3, "2026-01-16T00:00:00"),
        (4, 9, "10", None, "2026-01-10T00:00:00"), (5, 9, "10", 4, "2026-01-10T00:00:00"),
    )
    rates = table(RATES, (3, "2026-01-10", "2"), (3, "2026-01-09", "9"), (4, "2026-01-08", "3"), (4, "2026-01-09", "4"), (4, "2026-01-10", None))
    assert rows(marts.converted_sales(orders, rates), "order_id", "converted_amount", "reporting_currency") == [
        (1, Decimal("20"), "USD"), (2, Decimal("20"), "USD"), (5, Decimal("40"), "USD"),
    ]
    assert rows(marts.unconverted_sales(orders, rates), "order_id", "reason") == [
        (3, "no exchange rate for currency_id=3 within 5 days of 2026-01-16"), (4, "no exchange rate for currency_id= within 5 days of 2026-01-10"),
    ]


def test_staged_latest(table):
    df = table({"id": "string", "name": "string", "write_date": "string"}, ("1", "old", "2026-01-01 00:00:00"), ("1", "new", "2026-01-02 00:00:00"), ("2", "x", None))
    typed = {"id": "bigint", "name": "string", "write_date": "timestamp_ntz"}
    assert rows(marts.staged_latest(df, typed, version="write_date"), "id", "name") == [(1, "new"), (2, "x")]


PARTNER = {"id": "bigint", "name": "string"}


def test_artist_dimension_and_summary(table):
    partners = table(PARTNER, (1, " Ana "), (2, "Bo"), (3, "   "), (4, "Cy"), (5, None), (6, "Ana"))
    dim = marts.dim_artist(partners)
    assert rows(dim)[:1] == sorted([(md5(str(i)), str(i), n) for i, n in [(1, "Ana"), (2, "Bo"), (3, None), (4, "Cy"), (5, None), (6, "Ana")]], key=lambda r: r[0])[:1]
    active = marts.dim_artist_active(dim, table({"platform_id": "string"}, ("2",), ("4",)))
    assert rows(active, "platform_id") == [("1",), ("3",), ("5",), ("6",)]
    assert rows(marts.artist_summary(active)) == [(4, 1, 1, 6)]


def test_partner_summary(table):
    partners = table(PARTNER, (1, "alice"), (2, "out"), (3, "Alice"), (4, "out"), (5, None), (6, "  "), (7, " bob "), (8, "bob"), (8, "bob"), (9, "cy"))
    assert rows(marts.partner_summary(partners, [2, 4])) == [(5, 4, 1, 9)]


def test_artist_assignment(table):
    prices = table({"id": "bigint", "detail_id": "bigint", "partner_id": "bigint"}, (1, 11, 1), (2, 11, 2), (3, None, 99), (4, 12, None))
    fact = marts.fact_artist_assignment(prices, table(PARTNER, (1, " Ana "), (2, "  ")))
    assert rows(fact, "production_plan_detail_id", "artist_id", "artist_name") == [(None, "99", None), ("11", "1", "Ana"), ("11", "2", None), ("12", None, None)]
    assert rows(fact, "fact_artist_assignment_sk")[0] in [(md5(str(i)),) for i in range(1, 5)]


@pytest.fixture
def usage(table):
    channels = table({"Id": "string", "YoutubeChannelId": "string"}, ("c1", " Y1 "), ("c2", "Y2"), ("c3", "  "), ("c4", "Y4"), ("c5", "Y1"))
    companies = table({"Id": "string", "ChannelId": "string", "CompanyId": "string", "IsDeleted": "boolean"},
                      ("1", "c1", "co", None), ("2", "c2", "other", False), ("3", "c3", "co", False), ("4", "c4", "co", True), ("5", "c5", "co", False))
    videos = table(
        {"YoutubeVideoId": "string", "YoutubeChannelId": "string", "Code": "string", "PublishedAt": "timestamp", "Title": "string"},
        ("V1", "Y1", "E1", "2026-01-01T00:00:00Z", " old "), ("V1", "Y1", " E1 ", "2026-01-02T00:00:00Z", " new "), (" V7 ", "Y1", "E2", "2026-01-03T00:00:00Z", None),
        ("V2", "Y2", "E1", "2026-01-01T00:00:00Z", "other company"), ("V3", "Y1", "E1", None, "unpublished"), ("V4", "Y1", None, "2026-01-01T00:00:00Z", "no code"),
        ("  ", "Y1", "E1", "2026-01-01T00:00:00Z", "no id"), ("V5", "Y4", "E1", "2026-01-01T00:00:00Z", "deleted link"),
    )
    dim = marts.dim_video(channels, companies, videos, "co")
    resources = table({"Id": "string", "ResourceFileId": "string", "ResourceType": "bigint"},
                      ("r1", "ST001", 0), ("r2", " st002 ", 0), ("r3", "ST003", 0), ("r4", "ST004", 1), ("r5", "XX005", 0))
    uses = table(
        {"Id": "string", "EditingId": "string", "ResourcesId": "string", "StartTime": "double", "EndTime": "double"},
        ("u1", "e1", "r3", 0.0, 1.5), ("u2", "e1", "r1", 1.0, 2.0), ("u3", "e1", "r2", 1.0, 3.25), ("u4", "e1", "r1", 5.0, 6.0),
        ("u4", "e1", "r1", 5.0, 6.0), ("u5", "e1", "r4", 0.5, 1.0), ("u6", "e1", "r5", 0.5, 1.0), ("u7", "e2", "r2", 0.0, 1.0), ("u8", "e9", "r1", 0.0, 1.0),
    )
    editings = table({"Id": "string", "EditingFileId": "string"}, ("e1", "E1"), ("e2", "E2"))
    excluded = marts.excluded_stock(table({"stock_id": "string"}, (" st003 ",), ("",), (None,), ("ST003",)))
    return dim, marts.fact_editing(uses, editings, resources, excluded, "ST"), excluded


def test_video_dimension(usage):
    dim = usage[0]
    assert rows(dim, "video_id", "editing_code", "video_name") == [("V1", "E1", "new"), ("V3", "E1", "unpublished"), ("V4", None, "no code"), ("V7", "E2", None)]
    v7 = dim.where("video_id = 'V7'").first()
    assert v7["dim_video_sk"] == md5(" V7 ") and v7["video_url"].endswith("watch?v= V7 ")
    assert v7["published_date"] == dt.datetime(2026, 1, 3)


def test_editing_fact(usage):
    """Excluded codes take no position, exact copies count once, and equal start times go by id."""
    _, fact, excluded = usage
    assert rows(excluded) == [("ST003",)]
    assert rows(fact, "editing_id", "position", "stock_id", "duration") == [
        ("e1", 1, "ST001", Decimal("1")), ("e1", 2, "ST002", Decimal("2.25")), ("e1", 3, "ST001", Decimal("1")), ("e2", 1, "ST002", Decimal("1")),
    ]


def test_resource_usage(usage):
    report = marts.resource_usage(usage[0], usage[1])
    assert rows(report, "video_id", "stock_id", "first_position", "position_group") == [
        ("V1", "ST001", 1, "1"), ("V1", "ST002", 2, "2-3"), ("V7", "ST002", 1, "1"),
    ]
    assert report.where("video_id = 'V1' and stock_id = 'ST001'").first()["resource_video_sk"] == md5("V1", "ST001")


def test_conflicting_copies_show_up_as_a_repeated_key(table, usage):
    uses = table({"Id": "string", "EditingId": "string", "ResourcesId": "string", "StartTime": "double", "EndTime": "double"}, ("u1", "e1", "r1", 0.0, 1.0), ("u1", "e1", "r1", 0.0, 2.0))
    fact = marts.fact_editing(uses, table({"Id": "string", "EditingFileId": "string"}, ("e1", "E1")),
                              table({"Id": "string", "ResourceFileId": "string", "ResourceType": "bigint"}, ("r1", "ST001", 0)), usage[2], "ST")
    assert not run_gates({"fact": fact}, [Unique("fact", ["fact_editing_sk"])]).passed


SLA_ORDERS = [
    (1, "sale", "2026-01-10T10:00:00", None), (2, "done", "2026-01-31T23:00:00", "2026-02-10T00:00:00"), (3, "sale", "2026-01-05T00:00:00", None),
    (4, "draft", "2026-01-06T00:00:00", None), (5, "cancel", "2026-03-01T00:00:00", None), (6, "sale", "2026-02-01T00:00:00", None),
]
SLA_PICKINGS = [
    (1, "outgoing", "done", "2026-01-13T10:00:00"), (1, "outgoing", "done", "2026-01-20T00:00:00"), (2, "outgoing", "done", "2026-02-10T00:00:01"),
    (2, "incoming", "done", "2026-02-01T00:00:00"), (2, "outgoing", "assigned", "2026-02-02T00:00:00"), (3, "outgoing", "done", None),
    (None, "outgoing", "done", "2026-01-05T00:00:00"), (6, "outgoing", "done", "2026-02-05T00:00:00"), (6, "outgoing", "done", "2026-02-03T00:00:00"),
]


def sla(table, orders=SLA_ORDERS, pickings=SLA_PICKINGS):
    a = table({"id": "bigint", "state": "string", "date_order": "timestamp_ntz", "commitment_date": "timestamp_ntz"}, *orders)
    b = table({"sale_id": "bigint", "picking_type": "string", "state": "string", "date_done": "timestamp_ntz"}, *pickings)
    return rows(marts.delivery_sla(a, b))


SLA = [("2026-01", 3, 2, 1, Decimal("33.3")), ("2026-02", 1, 1, 1, Decimal("100.0"))]


def test_delivery_sla(table):
    assert sla(table) == SLA


@pytest.mark.parametrize("name,value", [
    ("ELIGIBLE_STATES", ("sale",)), ("ELIGIBLE_STATES", ("sale", "done", "draft")), ("DELIVERY_TYPE", "incoming"), ("DELIVERY_STATE", "assigned"), ("PROMISE_HOURS", 71),
])
def test_wrong_readings_change_the_answer(table, monkeypatch, name, value):
    monkeypatch.setattr(marts, name, value)
    assert sla(table) != SLA


def test_plan_detail(table):
    details = table({"id": "bigint", "plan_id": "bigint", "produce_manager": "bigint", "ar_id": "bigint", "state": "string", "quality": "string"}, (1, 5, None, 7, " open ", "x"), (2, None, 1, None, "  ", "x"))
    fact = marts.fact_plan_detail(details)
    assert fact.columns == ["fact_plan_detail_sk", "production_plan_detail_id", "production_plan_id", "production_manager", "ar_manager", "status"]
    assert rows(fact.drop("fact_plan_detail_sk")) == [("1", "5", None, "7", "open"), ("2", None, "1", None, None)]


def test_label_operation(table):
    songs = table(
        {"id": "bigint", "active": "boolean", "isrc": "string", "release_state": "string", "release_date": "date", "distro": "double", "purchase_order_id": "double"},
        (101, True, "VN1", " released ", "2026-01-15", 12.0, 51.0), (102, True, "VN1", "x", None, 1.0, 52.0), (90, False, "VN2", "x", None, 1.0, None),
        (120, True, "VN2", None, None, None, 53.0), (103, None, "VN3", "x", None, 1.0, None), (104, True, "  ", "x", None, 1.0, None), (109, True, " VN1 ", "", None, 16.0, None), (107, True, "VN4", "r", None, 15.0, 99.0),
    )
    certificates = table({"purchase_order_id": "double", "acceptance_link": "string"}, (51.0, " https://example.org/51 "), (53.0, "   "), (54.0, "unused"))
    fact = marts.fact_label_operation(songs, certificates)
    assert rows(fact, "resource_id", "isrc", "release_status", "acceptance_url", "distributor") == [
        ("101", "VN1", "released", "https://example.org/51", "12"), ("107", "VN4", "r", None, "15"), ("109", "VN1", None, None, "16"), ("120", "VN2", None, None, None),
    ]
    assert fact.where("resource_id = '101'").first()["release_date"] == dt.datetime(2026, 1, 15)
    assert dict(fact.dtypes)["release_date"] == "timestamp_ntz"
    doubled = certificates.unionByName(certificates.where(F.col("purchase_order_id") == 51))
    assert not run_gates({"c": doubled}, [Unique("c", ["purchase_order_id"])]).passed
