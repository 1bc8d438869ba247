"""Ledger reports over a ledger made from the given tables: orders are runs, lines are stages and gates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.catalog.base import Tables, query
from sluiceway.ledger import reports

# The ledger tables are plain SQL both engines read alike.
_RUNS = """select o_orderkey as id, case when o_custkey % 6 = 0 then 'verify' else 'data' end as kind, 'flow' || (o_custkey % 40) as target,
    case o_orderstatus when 'F' then 'ok' when 'O' then 'failed' else 'running' end as status, o_orderdate as started_at,
    case when o_orderstatus = 'P' then null else o_orderdate + interval '1' hour end as finished_at from {orders}"""
_STAGES = """select l_orderkey * 10 + l_linenumber as id, l_orderkey as run_id, 'flow' || (l_orderkey % 40) as pipeline, 'stage' || l_linenumber as stage,
    case min(l_returnflag) when 'A' then 'passed' when 'N' then 'failed' else 'running' end as status, cast(sum(l_quantity) as bigint) as row_count,
    min(l_shipdate) as started_at, case when min(l_returnflag) = 'R' then null else max(l_shipdate) + interval '90' second end as finished_at
    from {lineitem} group by l_orderkey, l_linenumber"""
_GATES = """select l_partkey * 100000 + l_suppkey as id, l_orderkey * 10 + l_linenumber as stage_run_id,
    case l_suppkey % 3 when 0 then 'unique' when 1 then 'not_null' else 'freshness' end as gate_type,
    case l_linestatus when 'F' then 'passed' else 'failed' end as status, cast(l_quantity as bigint) as rows_checked,
    cast(nullif(l_discount, 0) * 100 as bigint) as rows_rejected, 'part ' || l_partkey as detail, l_shipdate as ts from {lineitem}"""
_EVENTS = """select event_id as id, case when event_type = 'view' then null else event_id % 15000 end as run_id, ts,
    case event_type when 'error' then 'error' else 'info' end as level, 'kind.' || event_type as kind, 'user' || user_id as message from {events}"""
_WITH = "with " + ", ".join(
    f"{n} as ({s.replace('{', '').replace('}', '')})"
    for n, s in (("runs", _RUNS), ("stage_runs", _STAGES), ("gate_runs", _GATES), ("journal", _EVENTS))
)


def _ledger(t: Tables) -> dict[str, DataFrame]:
    return {
        "runs": t.spark.sql(_RUNS, orders=t.orders), "stage_runs": t.spark.sql(_STAGES, lineitem=t.lineitem),
        "gate_runs": t.spark.sql(_GATES, lineitem=t.lineitem), "events": t.spark.sql(_EVENTS, events=t.events),
    }


@query("ledger_latest", "L2", _WITH + """
    select target, id, status, started_at, finished_at from runs where kind = 'data'
    qualify row_number() over (partition by target order by id desc) = 1""")
def ledger_latest(t: Tables) -> DataFrame:
    return reports.latest_runs(_ledger(t)["runs"], "data").select("target", "id", "status", "started_at", "finished_at")


@query("ledger_latest_stage", "L3", _WITH + """
    select pipeline, stage, id, status, row_count from stage_runs where status <> 'running'
    qualify row_number() over (partition by pipeline, stage order by id desc) = 1""")
def ledger_latest_stage(t: Tables) -> DataFrame:
    return reports.latest_finished_stages(_ledger(t)["stage_runs"]).select("pipeline", "stage", "id", "status", "row_count")


@query("ledger_status", "L4", _WITH + """,
    latest as (select target, id as run_id, status as run_status from runs qualify row_number() over (partition by target order by id desc) = 1),
    lists as (select stage_run_id, string_agg(gate_type || ':' || status, ', ' order by id, gate_type || ':' || status) as gates from gate_runs group by 1)
    select target, s.run_id, run_status, s.id as stage_run_id, stage, s.status, row_count, coalesce(gates, 'none') as gates, started_at
    from stage_runs s join latest using (run_id) left join lists on stage_run_id = s.id""")
def ledger_status(t: Tables) -> DataFrame:
    tables = _ledger(t)
    return reports.status_table(tables["runs"], tables["stage_runs"], tables["gate_runs"])


@query("ledger_timeline", "L5", _WITH + """
    select run_id, started_at as ts, 'stage' as source, stage || ' ' || status as message from stage_runs
    union all select s.run_id, g.ts, 'gate', gate_type || ' ' || g.status || ' ' || detail from gate_runs g join stage_runs s on s.id = g.stage_run_id
    union all select run_id, ts, 'event', kind || ' ' || message from journal where run_id is not null""")
def ledger_timeline(t: Tables) -> DataFrame:
    tables = _ledger(t)
    return reports.audit_timeline(None, tables["stage_runs"], tables["gate_runs"], tables["events"])


@query("ledger_gate_summary", "L6", _WITH + """,
    docs as (select stage_run_id, id, cast(to_json({'type': gate_type, 'status': status, 'rows_checked': rows_checked, 'rows_rejected': rows_rejected}) as varchar) as doc from gate_runs)
    select run_id, s.id as stage_run_id, stage, '[' || string_agg(doc, ',' order by d.id, doc) || ']' as gates
    from stage_runs s join docs d on d.stage_run_id = s.id group by 1, 2, 3""")
def ledger_gate_summary(t: Tables) -> DataFrame:
    tables = _ledger(t)
    return reports.gate_summary(tables["stage_runs"], tables["gate_runs"])


_EXPIRED = """, expired as (select id from runs where kind = 'data' and status <> 'running' and finished_at < timestamp '2001-08-01' - interval 1000 day)"""
PRUNE_NOW = dt.datetime(2001, 8, 1)


@query("ledger_prune_counts", "L7", _WITH + _EXPIRED + """
    select 'runs' as table, count(*) as deleted from expired
    union all select 'stage_runs', count(*) from stage_runs where run_id in (select id from expired)
    union all select 'gate_runs', count(*) from gate_runs where stage_run_id in (select id from stage_runs where run_id in (select id from expired))
    union all select 'events', count(*) from journal where run_id in (select id from expired)""")
def ledger_prune_counts(t: Tables) -> DataFrame:
    return reports.prune(_ledger(t), PRUNE_NOW, 1000)[1]


@query("ledger_pruned_events", "L7", _WITH + _EXPIRED + """
    select id, run_id from journal where run_id is null or run_id not in (select id from expired)""")
def ledger_pruned_events(t: Tables) -> DataFrame:
    return reports.prune(_ledger(t), PRUNE_NOW, 1000)[0]["events"].select("id", "run_id")


@query("ledger_totals", "L8", _WITH + """
    select 'runs' as measure, count(*) as n from runs union all select 'events', count(*) from journal
    union all select 'stages_run', count(*) from stage_runs union all select 'gates_failed', count(*) from gate_runs where status = 'failed'""")
def ledger_totals(t: Tables) -> DataFrame:
    tables = _ledger(t)
    return reports.totals(tables["runs"], tables["stage_runs"], tables["gate_runs"], tables["events"])


@query("ledger_test_results", "L9", """
    select event_id % 100 as run_id, 'test.' || event_type as kind, 'stage' || (event_id % 4) as stage, 'unique.' || user_id as test,
           case when value > 50 then 'fail' else 'pass' end as status, user_id as failures from events where event_type <> 'view'
    union all select event_id % 100, 'test.' || event_type, 'stage' || (event_id % 4), 'not_null.' || event_id, 'pass', null from events where event_type <> 'view'""")
def ledger_test_results(t: Tables) -> DataFrame:
    """Test results out of event JSON; the 'view' events hold broken JSON and give nothing."""
    tests = F.array(
        F.struct(
            F.concat(F.lit("unique."), "user_id").alias("test"),
            F.when(F.col("value") > 50, "fail").otherwise("pass").alias("status"), F.col("user_id").alias("failures"),
        ),
        F.struct(
            F.concat(F.lit("not_null."), "event_id").alias("test"), F.lit("pass").alias("status"),
            F.lit(None).cast("bigint").alias("failures"),
        ),
    )
    stage = F.concat(F.lit("stage"), (F.col("event_id") % 4).cast("string")).alias("stage")
    record = F.to_json(F.struct(stage, F.lit("failed").alias("status"), tests.alias("tests")))
    events = t.events.select(
        (F.col("event_id") % 100).alias("run_id"), F.concat(F.lit("test."), "event_type").alias("kind"),
        F.when(F.col("event_type") == "view", '{"stage": ').otherwise(record).alias("data_json"),
    )
    return reports.tests_from_events(events)


@query("ledger_durations", "L10", _WITH + """
    select run_id, id as stage_run_id, stage, status, row_count, cast(epoch(finished_at) - epoch(started_at) as bigint) as seconds from stage_runs""")
def ledger_durations(t: Tables) -> DataFrame:
    return reports.stage_durations(_ledger(t)["stage_runs"])


@query("ledger_run_durations", "L10", _WITH + """
    select run_id, count(*) as stages, cast(sum(epoch(finished_at) - epoch(started_at)) as bigint) as stage_seconds,
           cast(epoch(max(finished_at)) - epoch(min(started_at)) as bigint) as wall_seconds from stage_runs group by 1""")
def ledger_run_durations(t: Tables) -> DataFrame:
    return reports.run_durations(_ledger(t)["stage_runs"])


@query("ledger_reconcile", "L11", _WITH + """,
    reported as (select id, status from runs where id % 5 <> 0),
    recorded as (select id, case when id % 7 = 0 then 'failed' else status end as status from runs where id % 11 <> 0),
    j as (select coalesce(a.id, b.id) as id, a.id as a_id, b.id as b_id, a.status as reported_status, b.status as recorded_status
          from reported a full join recorded b on a.id = b.id)
    select id, reported_status, recorded_status,
           case when a_id is null then 'not reported' when b_id is null then 'not recorded' else 'differs' end as problem
    from j where a_id is null or b_id is null or reported_status <> recorded_status""")
def ledger_reconcile(t: Tables) -> DataFrame:
    runs = _ledger(t)["runs"].select("id", "status")
    recorded = runs.where("id % 11 <> 0").withColumn("status", F.when(F.col("id") % 7 == 0, "failed").otherwise(F.col("status")))
    return reports.reconcile(runs.where("id % 5 <> 0"), recorded, ["id"], ["status"])


@query("batch_completeness", "L12", """
    select o_custkey as batch_id, count(*) as tables, count(*) filter (where o_orderstatus <> 'P') as loaded,
           count(*) = 10 and count(*) filter (where o_orderstatus <> 'P') = 10 as complete from orders group by 1""")
def batch_completeness(t: Tables) -> DataFrame:
    batches = t.orders.select(
        F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "P", "extracted").otherwise("loaded").alias("status")
    )
    return reports.batch_completeness(batches, 10)


@query("send_done_reconcile", "L13", """
    with sends as (select event_id, event_type, user_id from events where event_type in ('view', 'click')),
         ends as (select event_id - 1 as event_id, event_type from events where event_type in ('purchase', 'signup', 'error'))
    select 'sent' as measure, event_type as name, count(*) as n from sends group by 2
    union all select 'outcome', event_type, count(*) from ends where event_type <> 'error' group by 2
    union all select 'unfinished', 'all', count(*) from sends where event_id not in (select event_id from ends)""")
def send_done_reconcile(t: Tables) -> DataFrame:
    """Views and clicks are sends; the next event ends one, and an error ends it without an outcome."""
    sends = t.events.where("event_type in ('view', 'click')").select("event_id", "event_type")
    ends = t.events.where("event_type in ('purchase', 'signup', 'error')").select(
        (F.col("event_id") - 1).alias("event_id"), F.nullif("event_type", F.lit("error")).alias("outcome")
    )
    return reports.send_outcomes(sends, ends, "event_id", "event_type", "outcome")


@query("unfinished_sends", "L13", """
    select event_id, user_id from events where event_type in ('view', 'click')
    and event_id not in (select event_id - 1 from events where event_type in ('purchase', 'signup', 'error'))""")
def unfinished_sends(t: Tables) -> DataFrame:
    sends = t.events.where("event_type in ('view', 'click')").select("event_id", "user_id")
    ends = t.events.where("event_type in ('purchase', 'signup', 'error')").select((F.col("event_id") - 1).alias("event_id"))
    return reports.unfinished(sends, ends, "event_id").select("event_id", "user_id")


@query("newest_unmatched", "L14", "select event_id as id, user_id, value > 60 as matched from events where event_type = 'error' and not value > 60 order by id desc limit 20")
def newest_unmatched(t: Tables) -> DataFrame:
    """The limit is the report's own."""
    failures = t.events.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", (F.col("value") > 60).alias("matched"))
    return reports.newest_unmatched(failures, 20)
