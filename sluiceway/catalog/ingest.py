"""Sources, merges, bronze batches, the staged run and the stream, over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway import bronze
from sluiceway.bronze.batch import registry
from sluiceway.catalog.base import Tables, query
from sluiceway.functions import money
from sluiceway.gates import NotNull, Quarantine, ReferentialIntegrity, RowCountBounds, SchemaContract, Unique
from sluiceway.ledger import reports
from sluiceway.ledger.store import Ledger
from sluiceway.operators.merge import latest_versions, merge_changes
from sluiceway.plans import marts
from sluiceway.plans.staged import Flow, Stage, run_flow
from sluiceway.plans.store import TableStore
from sluiceway.session import scratch_path
from sluiceway.sources.files import read_csv, read_seed
from sluiceway.sources.jdbc import Incremental, load_table
from sluiceway.sources.shape import child_table, flatten, sheet_table
from sluiceway.sources.web import hits_table, records_as
from sluiceway.streaming.ingest import file_stream, ingest

SPLIT = dt.datetime(2024, 1, 20)


def _store(t: Tables, label: str) -> TableStore:
    return TableStore(t.spark, scratch_path(t.spark, label))


# ---- files and semi-structured rows

@query("csv_landing", "S7", """
    select cast(p_partkey as varchar) as p_partkey, '  ' || p_name || ' "x", ' || chr(10) || 'y' as p_name, p_brand, cast(p_size as varchar) as p_size from part""")
def csv_landing(t: Tables) -> DataFrame:
    """Everything lands as text, untrimmed: doubled quotes, a comma and a line break in a field, and files whose headers
    differ in their order. The files are plain text, not made by a CSV writer."""
    folder = scratch_path(t.spark, "csv")
    name = F.concat(F.lit("  "), "p_name", F.lit(' "x", \ny'))
    fields = {"p_partkey": F.col("p_partkey"), "p_name": F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')), "p_brand": F.col("p_brand"), "p_size": F.col("p_size")}
    for odd, header in enumerate((list(fields), list(fields)[::-1])):
        line = F.concat_ws(",", *[fields[c].cast("string") for c in header])
        # The first row of every partition, and so of every file, comes after the header.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        rows = t.part.where(F.col("p_partkey") % 2 == odd)
        rows.select(F.when(first, F.concat(F.lit(",".join(header) + "\n"), line)).otherwise(line).alias("value")).write.mode("append").text(folder)
    return read_csv(t.spark, folder)


@query("seed_lookup", "S22", "select n_nationkey, n_name, n_regionkey from nation")
def seed_lookup(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "seed")
    t.nation.write.option("header", True).csv(folder)
    return read_seed(t.spark, folder, "n_nationkey int, n_name string, n_regionkey int")


@query("rest_records", "S8", "select conv_id, turn, role, text from conversations")
def rest_records(t: Tables) -> DataFrame:
    """The shaping half of the API reader: records as JSON text to declared columns."""
    records = t.conversations.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    return records_as(records, "conv_id bigint, turn bigint, role string, text string")


@query("index_documents", "S9", "select doc_id, lang, n_chars, 'doc-' || doc_id as _id from documents")
def index_documents(t: Tables) -> DataFrame:
    """The shaping half of the index reader: `_source` columns and `_id`."""
    hits = t.documents.select(F.to_json(F.struct(
        F.concat(F.lit("doc-"), "doc_id").alias("_id"), F.struct("doc_id", "lang", "n_chars").alias("_source")
    )).alias("hit"))
    return hits_table(hits, "doc_id: bigint, lang: string, n_chars: bigint")


@query("sheet_rows", "S10", """
    select cast(event_id as varchar) as id, case when event_id % 4 > 0 then event_type end as kind,
           case when event_id % 4 > 1 then cast(user_id as varchar) end as user from events""")
def sheet_rows(t: Tables) -> DataFrame:
    """Rows of one to four cells under three headers."""
    cells = F.array(F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"), F.lit("beyond"))
    length = (F.col("event_id") % 4 + 1).cast("int")
    rows = t.events.select((F.col("event_id") + 2).alias("row_number"), F.slice(cells, F.lit(1), length).alias("cells"))
    return sheet_table(rows, ["id", "kind", "user"])


@query("flatten_props", "S11", "select event_id, cast(json_extract(props, '$.k') as bigint) as props__k, user_id as owner__user_id, event_type as owner__event_type from events")
def flatten_props(t: Tables) -> DataFrame:
    nested = t.events.select(
        "event_id", F.from_json("props", "k bigint").alias("props"), F.struct("user_id", "event_type").alias("owner")
    )
    return flatten(nested)


@query("child_rows", "S11", """
    select conv_id * 1000 + turn as _parent_id, unnest(range(len(w))) as _position, unnest(w) as value
    from (select conv_id, turn, string_split(text, '.') as w from conversations)""")
def child_rows(t: Tables) -> DataFrame:
    parents = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", r"\.").alias("parts"))
    return child_table(parents, "id", "parts").withColumn("_position", F.col("_position").cast("bigint"))


# ---- incremental loads

_LATEST = """select user_id, event_type, event_id, ts, value from events
    qualify row_number() over (partition by user_id, event_type order by ts desc nulls first, event_id, value) = 1"""


def _kept_events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", "event_id", "ts", "value")


@query("incremental_merge", "S3 S4", _LATEST)
def incremental_merge(t: Tables) -> DataFrame:
    """Old rows merged with the rows at or past the cursor."""
    events = _kept_events(t)
    base = latest_versions(events.where(F.col("ts") < F.lit(SPLIT)), ["user_id", "event_type"], "ts")
    return merge_changes(base, events.where(F.col("ts") >= F.lit(SPLIT)), ["user_id", "event_type"], "ts")


def _loads(t: Tables) -> tuple[TableStore, list[dict]]:
    store, rule, events = _store(t, "loads"), Incremental("ts", ["user_id", "event_type"]), _kept_events(t)
    old = events.where(F.col("ts") < F.lit(SPLIT))
    done = [
        load_table(store, "landing", "events", source, version, rule)
        for version, source in (("1", old), ("2", events), ("3", events))
    ]
    return store, done


@query("incremental_loads", "S3 S4 S12 S13", _LATEST)
def incremental_loads(t: Tables) -> DataFrame:
    """First load, incremental load, and a repeat that changes nothing, through the store."""
    return _loads(t)[0].read("landing", "events")


@query("incremental_row_counts", "S3 S13", """
    select 1 as load, 'replace' as mode, count(*) as extracted from (select distinct user_id, event_type from events where ts < timestamp '2024-01-20')
    union all select 2, 'merge', count(*) from events where ts >= (select max(ts) from events where ts < timestamp '2024-01-20')
    union all select 3, 'merge', count(*) from events where ts >= (select max(ts) from events)""")
def incremental_row_counts(t: Tables) -> DataFrame:
    rows = [(i, d["mode"], d["extracted"]) for i, d in enumerate(_loads(t)[1], 1)]
    return t.spark.createDataFrame(rows, "load int, mode string, extracted bigint")


@query("widened_merge", "S4", """
    select o_orderkey, cast(o_custkey as decimal(20,0)) as o_custkey, cast(o_totalprice as decimal(18,3)) as price,
           case when o_orderkey % 3 = 0 then cast(cast(o_orderdate as date) as timestamp) else o_orderdate end as moment,
           case when o_orderkey % 3 = 0 then substr(o_orderpriority, 1, 1) else o_orderpriority end as priority,
           case when o_orderkey % 3 = 2 then o_orderstatus end as status
    from orders""")
def widened_merge(t: Tables) -> DataFrame:
    """Three loads whose columns grow: int to long to decimal, a date to a timestamp, a number to text, and a new column."""
    def load(third: int, custkey: str, price: str, moment: str, priority, *more):
        return t.orders.where(F.col("o_orderkey") % 3 == third).select(
            "o_orderkey", F.col("o_custkey").cast(custkey).alias("o_custkey"), F.col("o_totalprice").cast(price).alias("price"),
            F.col("o_orderdate").cast(moment).alias("moment"), priority.alias("priority"), *more)

    store, code = _store(t, "widened"), F.substring("o_orderpriority", 1, 1).cast("int")
    rule = Incremental("moment", ["o_orderkey"])
    first = load(0, "int", "decimal(12,2)", "date", code)
    second = load(1, "bigint", "decimal(17,2)", "timestamp_ntz", F.col("o_orderpriority"))
    third = load(2, "decimal(20,0)", "decimal(14,3)", "timestamp_ntz", F.col("o_orderpriority"), F.col("o_orderstatus").alias("status"))
    load_table(store, "landing", "orders", first, "1", rule)
    for version, more in (("2", second), ("3", third)):
        store.merge(store.current("landing", "orders"), more, version)
    return store.read("landing", "orders")


_LATE = """with first as (select * from events where ts < timestamp '2024-01-20' and event_id % 7 <> 3),
    bound as (select max(ts) as high, max(ts) - interval 5 day as low from first),
    second as (select e.* from events e, bound where ts >= low and not (ts < timestamp '2024-01-20' and event_id % 7 <> 3)),
    missed as (select e.* from events e, bound where ts < low and event_id % 7 = 3)"""


def _late_loads(t: Tables) -> tuple[TableStore, list[dict]]:
    """Before the split every seventh event comes a load too late."""
    store, events = _store(t, "late"), _kept_events(t)
    rule = Incremental("ts", ["event_id"], look_back=dt.timedelta(days=5), count_missed=True)
    early = events.where((F.col("ts") < F.lit(SPLIT)) & (F.col("event_id") % 7 != 3))
    done = [
        load_table(store, "landing", "events", source, version, rule)
        for version, source in (("1", early), ("2", events), ("3", events))
    ]
    return store, done


@query("late_rows", "S3 S4", _LATE + """
    select user_id, event_type, event_id, ts, value from first
    union all select user_id, event_type, event_id, ts, value from second""")
def late_rows(t: Tables) -> DataFrame:
    """Late rows land inside the look-back window only; a third load reads nothing new."""
    return _late_loads(t)[0].read("landing", "events")


@query("late_row_counts", "S3 S13", _LATE + """
    select 1 as load, count(*) as extracted, 0 as late, 0 as missed from first
    union all select 2, (select count(*) from second), (select count(*) from second, bound where ts < high), (select count(*) from missed)
    union all select 3, 0, 0, (select count(*) from missed m, (select max(ts) - interval 5 day as low from events) where ts < low)""")
def late_row_counts(t: Tables) -> DataFrame:
    rows = [(i, d["extracted"], d["late"], d["missed"]) for i, d in enumerate(_late_loads(t)[1], 1)]
    return t.spark.createDataFrame(rows, "load int, extracted bigint, late bigint, missed bigint")


@query("full_refresh", "S5 S6", "select user_id, event_type, event_id, ts, value from events where event_type <> 'error'")
def full_refresh(t: Tables) -> DataFrame:
    """Rows deleted at the source go only with a full refresh."""
    store, rule = _store(t, "refresh"), Incremental("ts", ["event_id"])
    load_table(store, "landing", "events", _kept_events(t), "1", rule)
    load_table(store, "landing", "events", _kept_events(t).where("event_type <> 'error'"), "2", rule, full_refresh=True)
    return store.read("landing", "events")


# ---- bronze

def _bronze(t: Tables) -> tuple[str, TableStore, str]:
    root, store = scratch_path(t.spark, "bronze"), _store(t, "bronze-landing")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice").alias("price"), "l_shipdate")
    tables = {"lines": lines, "events": t.events, "none": t.nation.where("n_nationkey < 0")}
    batch_id = bronze.extract(t.spark, root, "demo", tables, chunk_rows=50_000)
    bronze.load(t.spark, root, "demo", batch_id, store)
    return root, store, batch_id


@query("bronze_landing", "S14 S15 S16 S18 S20", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(20,2)) as price, l_shipdate from lineitem""")
def bronze_landing(t: Tables) -> DataFrame:
    """Extract, verify and load; decimals travel as exact text and integers widened, and both come back."""
    return _bronze(t)[1].read("demo_landing", "lines")


@query("bronze_registry", "S17 S18 S19 S21", """
    select 'lines' as table, 'loaded' as status, count(*) as total_rows, true as consistent from lineitem
    union all select 'events', 'loaded', count(*), true from events union all select 'none', 'loaded', 0, true""")
def bronze_registry(t: Tables) -> DataFrame:
    """Registry after the load; consistent when every object is within the chunk and all counts agree."""
    root, store, batch_id = _bronze(t)
    rows = []
    for e in registry(t.spark, root).where(F.col("batch_id") == batch_id).collect():
        seen = t.spark.read.parquet(f"{e['path']}/_manifest").agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")
        ).first()
        landed = store.read("demo_landing", e["table"]).count()
        rows.append((e["table"], e["status"], e["total_rows"], seen["n"] == landed == e["total_rows"] and seen["most"] <= 50_000))
    return t.spark.createDataFrame(rows, "table string, status string, total_rows bigint, consistent boolean")


# ---- the staged run

def _line_flow(t: Tables) -> Flow:
    def lines(_spark):
        return t.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("order_id"),
            F.concat(F.lit("p"), "l_partkey").alias("customer"), "l_orderkey",
            F.when(F.col("l_discount") > 0, money("l_extendedprice").cast("string")).otherwise("").alias("amount"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("order_date"),
        )

    def raw(m):
        typed = marts.raw_orders(m["lines"].withColumn("amount", F.nullif("amount", F.lit(""))).select(
            "order_id", "customer", "amount", "order_date"))
        return typed.withColumn("parent", F.floor(F.col("order_id") / 10))

    return Flow(
        "line_orders",
        sources={"lines": lines, "parents": lambda _s: t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")},
        landing_gates=[SchemaContract({"lines": {"order_id": "text", "amount": "text"}}), RowCountBounds("lines", min=1)],
        stages=[
            Stage("raw", {"orders_raw": raw}, [
                NotNull("orders_raw", ["amount"]), Unique("orders_raw", ["order_id"]),
                ReferentialIntegrity("orders_raw", "parent", {"table": "parents", "column": "o_orderkey"}),
            ], Quarantine(50), depends_on="landing"),
            Stage("curated", {"orders_with_vat": lambda m: marts.orders_with_vat(m["orders_raw"])},
                  [RowCountBounds("orders_with_vat", min=1)], depends_on="raw"),
        ],
    )


_FLOW = """with raw as (
        select l_orderkey * 10 + l_linenumber as order_id, 'p' || l_partkey as customer, l_orderkey,
               case when l_discount > 0 then cast(l_extendedprice as decimal(20,2)) end as amount, cast(l_shipdate as date) as order_date from lineitem),
    s1 as (select * from raw where amount is not null),
    s2 as (select * from s1 where order_id not in (select order_id from s1 group by 1 having count(*) > 1)),
    s3 as (select * from s2 where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'P'))"""


@query("staged_flow", "T46 S23 G11 M1", _FLOW + """
    select order_id, customer, amount, cast(round(amount * 1.10, 2) as decimal(23,2)) as amount_with_vat, order_date from s3""")
def staged_flow(t: Tables) -> DataFrame:
    """Landing, raw behind three gates, curated: the published result."""
    store = _store(t, "flow")
    run = run_flow(t.spark, _line_flow(t), store)
    if run.status != "ok":
        raise RuntimeError(run.problem)
    return store.read("line_orders", "orders_with_vat")


@query("staged_flow_gates", "L1 L4 G14 G15", _FLOW + """
    select 'landing' as stage, 'schema_contract' as gate_type, 'passed' as status, cast(null as bigint) as rows_checked, cast(null as bigint) as rows_rejected
    union all select 'landing', 'row_count_bounds', 'passed', count(*), null from raw
    union all select 'raw', 'not_null', 'passed', (select count(*) from raw), (select count(*) from raw) - (select count(*) from s1)
    union all select 'raw', 'unique', 'passed', (select count(*) from s1), (select count(*) from s1) - (select count(*) from s2)
    union all select 'raw', 'referential_integrity', 'passed', (select count(*) from s2), (select count(*) from s2) - (select count(*) from s3)
    union all select 'curated', 'row_count_bounds', 'passed', count(*), null from s3""")
def staged_flow_gates(t: Tables) -> DataFrame:
    """What the ledger recorded about the same run."""
    store = _store(t, "flow")
    run_flow(t.spark, _line_flow(t), store)
    ledger = Ledger(t.spark, f"{store.root}/_ledger")
    stages = reports.latest_finished_stages(ledger.table("stage_runs")).select(F.col("id").alias("stage_run_id"), "stage")
    gates = ledger.table("gate_runs").join(stages, "stage_run_id")
    return gates.select("stage", "gate_type", "status", "rows_checked", "rows_rejected")


@query("staged_flow_quarantine", "G10 G12 G13", _FLOW + """
    select order_id, 'not_null: one of amount is null' as reason from raw where amount is null
    union all select order_id, 'unique: duplicate order_id' from s1 where order_id in (select order_id from s1 group by 1 having count(*) > 1)
    union all select order_id, 'referential_integrity: parent not found in parents.o_orderkey' from s2
    where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def staged_flow_quarantine(t: Tables) -> DataFrame:
    store = _store(t, "flow")
    run_flow(t.spark, _line_flow(t), store)
    return store.read_rejected("line_orders", "orders_raw").select("order_id", "reason")


# ---- the stream

def _streamed(t: Tables) -> TableStore:
    store = _store(t, "stream")
    rows = file_stream(t.spark, t.directory, t.events.schema, name_filter="events.parquet")
    kept = rows.select("user_id", "event_type", "event_id", "ts", F.nullif("value", F.lit(0.01)).alias("value"))
    ingest(
        kept, store, "stream", "events", ["user_id", "event_type"], "ts", scratch_path(t.spark, "stream-checkpoint"),
        gates=[NotNull("events", ["value"]), Unique("events", ["event_id"])], quarantine=Quarantine(10),
    ).awaitTermination()
    return store


@query("stream_ingest", "S3 S4 G15", """
    select user_id, event_type, event_id, ts, value from events where value <> 0.01
    qualify row_number() over (partition by user_id, event_type order by ts desc nulls first, event_id, value) = 1""")
def stream_ingest(t: Tables) -> DataFrame:
    """Arriving files, gated and merged by the stream."""
    return _streamed(t).read("stream", "events")


@query("stream_unique_gate", "G6 G8", """
    select event_id, user_id, cast(ts as date) as day, event_type, ts from events where user_id in (select c_custkey from customer where c_acctbal >= 0)
    qualify count(*) over (partition by user_id, cast(ts as date)) = 1""")
def stream_unique_gate(t: Tables) -> DataFrame:
    """Events in three micro-batches, each user's day at most once over all of them; users are landed customers."""
    store, folder, checkpoint = _store(t, "stream-unique"), scratch_path(t.spark, "stream-parts"), scratch_path(t.spark, "stream-checkpoint")
    kept = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "ts")
    store.replace("stream", {"users": t.customer.where("c_acctbal >= 0").select("c_custkey")}, "1")
    for part in range(3):
        # All files of a part are one micro-batch, so that many tasks write and read them.
        kept.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(folder)
        ingest(
            file_stream(t.spark, folder, kept.schema), store, "stream", "events", ["event_id"], "ts", checkpoint,
            gates=[ReferentialIntegrity("events", "user_id", {"table": "users", "column": "c_custkey"}), Unique("events", ["user_id", "day"])],
            quarantine=Quarantine(100), parents={"users": ("stream", "users")},
        ).awaitTermination()
    return store.read("stream", "events")
