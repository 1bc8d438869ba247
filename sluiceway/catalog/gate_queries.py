"""Gates, quarantine and test verdicts over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.catalog.base import Tables, query
from sluiceway.functions import money
from sluiceway.gates import (
    BusinessRule, Freshness, NotNull, Quarantine, ReferentialIntegrity, RowCountBounds, SchemaContract, Unique,
    run_gates, run_gates_one_by_one,
)
from sluiceway.gates.verdict import (
    ColumnTest, failing_rows, required_test_problems, run_column_tests, test_run_verdict,
)
from sluiceway.plans import marts

ALL = Quarantine(100)
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
NOW = dt.datetime(2024, 2, 2)


def _verdicts(t: Tables, outcome) -> DataFrame:
    rows = [(i, r.gate_type, r.status, r.rows_checked, r.rows_rejected) for i, r in enumerate(outcome.results)]
    return t.spark.createDataFrame(
        rows, "gate int, gate_type string, status string, rows_checked bigint, rows_rejected bigint"
    )


@query("gated_monthly_revenue", "G5 G6 G10 G11 M6 T4 T9 T13 T39", """
    with landing as (
        select l_orderkey * 10 + l_linenumber as id, case when l_returnflag = 'N' and l_discount = 0 then null else l_shipdate end as order_date,
               case l_linestatus when 'F' then ' DONE ' else 'draft' end as status, cast(l_extendedprice as decimal(20,2)) as amount
        from lineitem),
    dated as (select * from landing where order_date is not null),
    clean as (select * from dated where id not in (select id from dated group by id having count(*) > 1))
    select strftime(order_date, '%Y-%m') as month, count(*) as orders, cast(sum(amount) as decimal(30,2)) as revenue
    from clean where lower(trim(status)) = 'done' group by 1""")
def gated_monthly_revenue(t: Tables) -> DataFrame:
    """Completed revenue by month, behind a not-null and a unique gate."""
    landing = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_discount") == 0), None).otherwise(F.col("l_shipdate")).alias("order_date"),
        F.when(F.col("l_linestatus") == "F", " DONE ").otherwise("draft").alias("status"),
        money("l_extendedprice").alias("amount"),
    )
    gates = [NotNull("landing", ["order_date"]), Unique("landing", ["id"])]
    return marts.monthly_revenue(run_gates({"landing": landing}, gates, ALL).tables["landing"])


# ---- whole-table gates

@query("gate_structure", "G1 G2 G3 G4 G15", """
    select * from (
        select 0 as gate, 'schema_contract' as gate_type, 'passed' as status, cast(null as bigint) as rows_checked, cast(null as bigint) as rows_rejected
        union all select 1, 'schema_contract', 'failed', null, null
        union all select 2, 'freshness', case when max(ts) < timestamp '2024-02-02' - interval 7 day then 'failed' else 'passed' end, null, null from events
        union all select 3, 'freshness', case when max(ts) < timestamp '2024-02-02' - interval 24 hour then 'failed' else 'passed' end, null, null from events
        union all select 4, 'freshness', 'passed', null, null
        union all select 5, 'row_count_bounds', case when count(*) < 1 then 'failed' else 'passed' end, count(*), null from events
        union all select 6, 'row_count_bounds', case when count(*) > 10 then 'failed' else 'passed' end, count(*), null from events
        union all select 7, 'row_count_bounds', case when abs(count(*) - (select count(*) from orders)) * 100.0 / (select count(*) from orders) > 50 then 'failed' else 'passed' end, count(*), null from events
        union all select 8, 'row_count_bounds', case when abs(count(*) - (select count(*) from orders)) * 100.0 / (select count(*) from orders) > 10 then 'failed' else 'passed' end, count(*), null from events)""")
def gate_structure(t: Tables) -> DataFrame:
    """Contract, freshness and row counts with a fixed clock; one scan of each table answers all of them."""
    events = {"events": t.events, "nothing": t.events.where("event_id < 0")}
    gates = [
        SchemaContract({"events": {"event_id": "int8", "ts": "timestamp without time zone", "value": "double precision"}}),
        SchemaContract({"events": {"user_id": "text", "absent": "bigint"}}),
        Freshness(["events"], "ts", "7d"), Freshness(["events"], "ts", "24h"), Freshness(["nothing"], "ts", "1s"),
        RowCountBounds("events", min=1), RowCountBounds("events", max=10),
        RowCountBounds("events", max_delta_pct=50), RowCountBounds("events", max_delta_pct=10),
    ]
    return _verdicts(t, run_gates(events, gates, now=NOW, previous_counts={"events": t.orders.count()}))


# ---- row gates, one at a time

@query("gate_not_null", "G5 G12 G13", """
    select o_orderkey, o_custkey, cast(null as varchar) as priority, 'not_null: one of priority, o_custkey is null' as reason, cast(7 as bigint) as run_id
    from orders where o_orderpriority = '5-LOW'""")
def gate_not_null(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return run_gates({"rows": rows}, [NotNull("rows", ["priority", "o_custkey"])], ALL, run_id=7).rejected["rows"]


_DUPLICATES = "(select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)"


@query("gate_unique_rejected", "G6 G22", f"""
    select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice
    from lineitem l join {_DUPLICATES} d using (l_orderkey, l_linenumber)""")
def gate_unique_rejected(t: Tables) -> DataFrame:
    gate = Unique("lines", ["l_orderkey", "l_linenumber"])
    return run_gates({"lines": t.lineitem.select(*LINE)}, [gate], ALL).rejected["lines"].select(*LINE)


@query("gate_unique_null_keys", "G6", """
    with keyed as (select event_id, user_id, nullif(event_type, 'view') as kind from events)
    select event_id from keyed join (select user_id, kind from keyed group by 1, 2 having count(*) > 1) d using (user_id, kind)""")
def gate_unique_null_keys(t: Tables) -> DataFrame:
    """A key with a NULL in it repeats in the report but is never rejected."""
    keyed = t.events.select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return run_gates({"keyed": keyed}, [Unique("keyed", ["user_id", "kind"])], ALL).rejected["keyed"].select("event_id")


@query("gate_unique_keys", "G7", """
    with keyed as (select user_id, nullif(event_type, 'view') as kind from events)
    select user_id, kind, count(*) as n from keyed group by 1, 2 having count(*) > 1""")
def gate_unique_keys(t: Tables) -> DataFrame:
    keyed = t.events.select("user_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return Unique("keyed", ["user_id", "kind"]).report(keyed)


@query("gate_ref_integrity", "G8", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')""")
def gate_ref_integrity(t: Tables) -> DataFrame:
    tables = {"lines": t.lineitem.select(*LINE[:4]), "parents": t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")}
    gate = ReferentialIntegrity("lines", "l_orderkey", {"table": "parents", "column": "o_orderkey"})
    return run_gates(tables, [gate], ALL).rejected["lines"].select(*LINE[:4])


@query("gate_ref_integrity_nulls", "G8", """
    select c_custkey, nation from (select c_custkey, nullif(c_nationkey, 3) as nation from customer) c
    where nation is null or exists (select 1 from nation n where n_nationkey = c.nation and n_regionkey <> 2)""")
def gate_ref_integrity_nulls(t: Tables) -> DataFrame:
    """A NULL foreign key passes."""
    tables = {
        "rows": t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation")),
        "parents": t.nation.where("n_regionkey <> 2").select("n_nationkey"),
    }
    gate = ReferentialIntegrity("rows", "nation", {"table": "parents", "column": "n_nationkey"})
    return run_gates(tables, [gate], ALL).tables["rows"]


@query("gate_business_rule", "G9 T45", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    where l_orderkey in (select l_orderkey from lineitem group by 1 having count(distinct l_returnflag) > 1)""")
def gate_business_rule(t: Tables) -> DataFrame:
    """The rule names orders; every line of such an order is moved."""
    rows = t.lineitem.select(*LINE[:4], "l_returnflag")
    rule = BusinessRule(
        "one_flag_per_order", "select l_orderkey from order_lines group by l_orderkey having count(distinct l_returnflag) > 1",
        "order_lines", "l_orderkey",
    )
    return run_gates({"order_lines": rows}, [rule], ALL).rejected["order_lines"].select(*LINE[:4])


@query("gate_accepted_values", "G17", "select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F', 'O')")
def gate_accepted_values(t: Tables) -> DataFrame:
    test = ColumnTest("orders", "o_orderstatus", "accepted_values", values=("F", "O"))
    return failing_rows(t.orders.select("o_orderkey", "o_orderstatus"), test)


# ---- several gates in order

_STEPS = """
    with s0 as (select l_orderkey, l_linenumber, l_suppkey, case when l_partkey % 50 = 7 then null else l_partkey end as l_partkey,
                       l_quantity, l_extendedprice from lineitem),
    r0 as (select * from s0 where l_partkey is null),
    s1 as (select * from s0 where l_partkey is not null),
    k1 as (select l_orderkey, l_linenumber from s1 group by 1, 2 having count(*) > 1),
    r1 as (select s1.* from s1 join k1 using (l_orderkey, l_linenumber)),
    s2 as (select s1.* from s1 anti join k1 using (l_orderkey, l_linenumber)),
    r2 as (select * from s2 where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')),
    s3 as (select * from s2 where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')),
    k3 as (select l_suppkey from s3 group by 1 having sum(cast(l_extendedprice as decimal(20,2))) > 13000000),
    r3 as (select * from s3 where l_suppkey in (select l_suppkey from k3)),
    s4 as (select * from s3 where l_suppkey not in (select l_suppkey from k3))"""

_COUNTS_SQL = _STEPS + """,
    counts as (
        select 0 as gate, 'not_null' as gate_type, (select count(*) from s0) as rows_checked, (select count(*) from r0) as rows_rejected
        union all select 1, 'unique', (select count(*) from s1), (select count(*) from r1)
        union all select 2, 'referential_integrity', (select count(*) from s2), (select count(*) from r2)
        union all select 3, 'business_rule', (select count(*) from s3), (select count(*) from k3)
        union all select 4, 'row_count_bounds', (select count(*) from s4), null)
    select gate, gate_type, case when rows_rejected * 100.0 / rows_checked > 40 then 'failed' else 'passed' end as status,
           rows_checked, rows_rejected from counts"""


def _line_tables(t: Tables) -> dict[str, DataFrame]:
    part = F.when(F.col("l_partkey") % 50 != 7, F.col("l_partkey")).alias("l_partkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", part, "l_suppkey", "l_quantity", "l_extendedprice")
    return {"lines": lines, "parents": t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")}


LINE_GATES = [
    NotNull("lines", ["l_partkey"]),
    Unique("lines", ["l_orderkey", "l_linenumber"]),
    ReferentialIntegrity("lines", "l_orderkey", {"table": "parents", "column": "o_orderkey"}),
    BusinessRule(
        "supplier_total", "select l_suppkey from lines group by l_suppkey having sum(cast(l_extendedprice as decimal(20,2))) > 13000000",
        "lines", "l_suppkey",
    ),
    RowCountBounds("lines", min=1),
]


@query("gate_fused_counts", "G14 G15 G22", _COUNTS_SQL)
def gate_fused_counts(t: Tables) -> DataFrame:
    """Five gates in order, each seeing what the earlier ones left, in one wide scan."""
    return _verdicts(t, run_gates(_line_tables(t), LINE_GATES, Quarantine(40)))


@query("gate_key_counts", "G6 G8 G22", """
    with lines as (select *, case when l_partkey % 50 <> 7 then l_partkey end as part from lineitem)
    select 0 as gate, count(*) as rejected from (select 1 from lines qualify count(*) over (partition by l_orderkey, l_linenumber) > 1)
    union all select 1, count(*) from (select 1 from lines where part is not null qualify count(*) over (partition by part, l_suppkey) > 1)
    union all select 2, count(*) from lines where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')
    union all select 3, count(*) from lines where part not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def gate_key_counts(t: Tables) -> DataFrame:
    """Two unique and two referential gates that move nothing: one read of the lines and one aggregate for all."""
    gates = [
        Unique("lines", ["l_orderkey", "l_linenumber"]), Unique("lines", ["l_partkey", "l_suppkey"]),
        ReferentialIntegrity("lines", "l_orderkey", {"table": "parents", "column": "o_orderkey"}),
        ReferentialIntegrity("lines", "l_partkey", {"table": "parents", "column": "o_orderkey"}),
    ]
    seen = run_gates(_line_tables(t), gates)
    return t.spark.createDataFrame([(i, g.rows_rejected) for i, g in enumerate(seen.results)], "gate int, rejected bigint")


@query("gate_sequential_counts", "G14 G15 G22", _COUNTS_SQL)
def gate_sequential_counts(t: Tables) -> DataFrame:
    """The same gates, each run on its own."""
    return _verdicts(t, run_gates_one_by_one(_line_tables(t), LINE_GATES, Quarantine(40)))


@query("quarantine_rows", "G10 G12 G13", _STEPS + """
    select *, 'not_null: one of l_partkey is null' as reason, cast(42 as bigint) as run_id from r0
    union all select *, 'unique: duplicate l_orderkey, l_linenumber', 42 from r1
    union all select *, 'referential_integrity: l_orderkey not found in parents.o_orderkey', 42 from r2
    union all select *, 'business_rule: supplier_total', 42 from r3""")
def quarantine_rows(t: Tables) -> DataFrame:
    return run_gates(_line_tables(t), LINE_GATES, Quarantine(40), run_id=42).rejected["lines"]


@query("dequarantined_rows", "G11", _STEPS + " select * from s4")
def dequarantined_rows(t: Tables) -> DataFrame:
    return run_gates(_line_tables(t), LINE_GATES, Quarantine(40)).tables["lines"]


@query("gate_parent_first", "G8 G11", """
    with parents as (select o_orderkey, nullif(o_orderpriority, '1-URGENT') as priority from orders)
    select l_orderkey, count(*) as orphans from lineitem
    where l_orderkey in (select o_orderkey from parents where priority is null) group by 1""")
def gate_parent_first(t: Tables) -> DataFrame:
    """Lines of an order that an earlier gate moved are orphans for a later one."""
    tables = {
        "parents": t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority")),
        "lines": t.lineitem.select("l_orderkey", "l_linenumber"),
    }
    gates = [
        NotNull("parents", ["priority"]),
        ReferentialIntegrity("lines", "l_orderkey", {"table": "parents", "column": "o_orderkey"}),
    ]
    lost = run_gates(tables, gates, ALL).rejected["lines"]
    return lost.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("orphans"))


DECLARED = [
    ColumnTest("orders", "o_orderkey", "unique"), ColumnTest("orders", "o_custkey", "unique", severity="warn"),
    ColumnTest("orders", "o_custkey", "not_null"),
    ColumnTest("orders", "o_orderstatus", "accepted_values", values=("F", "O")),
    ColumnTest("lineitem", "l_linestatus", "accepted_values", values=("F", "O")),
]


@query("column_test_verdict", "G18 G19 G20", """
    with found as (
        select 'error' as severity, count(*) as n from (select o_orderkey from orders group by 1 having count(*) > 1)
        union all select 'warn', count(*) from (select o_custkey from orders group by 1 having count(*) > 1)
        union all select 'error', count(*) from orders where o_custkey is null
        union all select 'error', count(*) from orders where o_orderstatus not in ('F', 'O')
        union all select 'error', count(*) from lineitem where l_linestatus not in ('F', 'O'))
    select case when count(*) filter (where n > 0 and severity = 'error') > 0 then 'failed' else 'passed' end as status, count(*) as ran,
           count(*) filter (where n = 0) as passed, count(*) filter (where n > 0 and severity = 'error') as failed,
           count(*) filter (where n > 0 and severity = 'warn') as warned, 1 as unmet_requirements from found""")
def column_test_verdict(t: Tables) -> DataFrame:
    """The verdict on the run, and the required tests it does not meet (one is required with a severity it lacks)."""
    results = run_column_tests({"orders": t.orders, "lineitem": t.lineitem}, DECLARED)
    verdict = test_run_verdict(results, DECLARED, ["orders", "lineitem"])
    unmet = required_test_problems(results, [
        {"model": "orders", "column": "o_orderkey", "tests": ["unique"]}, {"model": "orders", "column": "o_custkey", "tests": ["not_null", "unique"]},
    ])
    row = (verdict["status"], verdict["ran"], verdict["passed"], verdict["failed"], verdict["warned"], len(unmet))
    return t.spark.createDataFrame([row], "status string, ran bigint, passed bigint, failed bigint, warned bigint, unmet_requirements int")


@query("column_tests", "G16 G17 G18 G19", """
    select 'unique.orders.o_orderkey' as test, case when count(*) > 0 then 'fail' else 'pass' end as status, count(*) as failures
    from (select o_orderkey from orders group by 1 having count(*) > 1)
    union all select 'unique.orders.o_custkey', case when count(*) > 0 then 'warn' else 'pass' end, count(*) from (select o_custkey from orders group by 1 having count(*) > 1)
    union all select 'not_null.orders.o_custkey', case when count(*) > 0 then 'fail' else 'pass' end, count(*) from orders where o_custkey is null
    union all select 'accepted_values.orders.o_orderstatus', case when count(*) > 0 then 'fail' else 'pass' end, count(*) from orders where o_orderstatus not in ('F', 'O')
    union all select 'accepted_values.lineitem.l_linestatus', case when count(*) > 0 then 'fail' else 'pass' end, count(*) from lineitem where l_linestatus not in ('F', 'O')""")
def column_tests(t: Tables) -> DataFrame:
    results = run_column_tests({"orders": t.orders, "lineitem": t.lineitem}, DECLARED)
    return t.spark.createDataFrame(
        [(r["test"], r["status"], r["failures"]) for r in results], "test string, status string, failures bigint"
    )
