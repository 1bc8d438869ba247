"""Reports over ledger tables (runs, stage_runs, gate_runs, events) of any size."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.aggregate import ordered_concat
from sluiceway.skew import broadcast_if_small


def latest_runs(runs: DataFrame, kind: str | None = None) -> DataFrame:
    """The newest run of each target."""
    rows = runs.where(F.col("kind") == kind) if kind else runs
    return rows.groupBy("target").agg(F.max_by(F.struct("*"), "id").alias("_r")).select("_r.*")


def latest_finished_stages(stage_runs: DataFrame) -> DataFrame:
    """The newest stage run that is not still running, per pipeline and stage; failed ones count."""
    done = stage_runs.where("status <> 'running'")
    return done.groupBy("pipeline", "stage").agg(F.max_by(F.struct("*"), "id").alias("_r")).select("_r.*")


def status_table(runs: DataFrame, stage_runs: DataFrame, gate_runs: DataFrame, kind: str | None = None) -> DataFrame:
    """Stages of each target's latest run, with rows and the gates in the order they ran."""
    latest = latest_runs(runs, kind).select("target", F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    stages = stage_runs.join(latest, "run_id")
    ids = stages.select(F.col("id").alias("stage_run_id"))
    text = F.concat_ws(":", "gate_type", "status")
    gates = ordered_concat(gate_runs.join(ids, "stage_run_id", "left_semi"), ["stage_run_id"], text, ["id"], "gates", ", ")
    joined = stages.join(gates, F.col("id") == F.col("stage_run_id"), "left")
    return joined.select(
        "target", "run_id", "run_status", F.col("id").alias("stage_run_id"), "stage", "status", "row_count",
        F.coalesce("gates", F.lit("none")).alias("gates"), "started_at",
    )


def audit_timeline(run_id: int | None, stage_runs: DataFrame, gate_runs: DataFrame, events: DataFrame) -> DataFrame:
    """Stages, gates and events of a run (of all runs when None) as one list of moments in order."""
    stages = stage_runs if run_id is None else stage_runs.where(F.col("run_id") == run_id)
    noted = events.where(F.col("run_id").isNotNull()) if run_id is None else events.where(F.col("run_id") == run_id)
    owners = stages.select(F.col("id").alias("stage_run_id"), "run_id", "started_at")
    a = stages.select("run_id", F.col("started_at").alias("ts"), F.lit("stage").alias("source"),
                      F.concat_ws(" ", "stage", "status").alias("message"))
    b = gate_runs.join(owners, "stage_run_id").select(
        "run_id", "ts", F.lit("gate").alias("source"), F.concat_ws(" ", "gate_type", "status", "detail").alias("message"))
    c = noted.select("run_id", "ts", F.lit("event").alias("source"), F.concat_ws(" ", "kind", "message").alias("message"))
    return a.unionByName(b).unionByName(c).orderBy("run_id", "ts", "source", "message")


def gate_summary(stage_runs: DataFrame, gate_runs: DataFrame) -> DataFrame:
    """Gate results of each stage run as a JSON list; two gates of one type stay apart."""
    owners = stage_runs.select(F.col("id").alias("stage_run_id"), "run_id", "stage")
    doc = F.to_json(
        F.struct(F.col("gate_type").alias("type"), "status", "rows_checked", "rows_rejected"), {"ignoreNullFields": "false"}
    )
    lists = ordered_concat(gate_runs, ["stage_run_id"], doc, ["id"], "gates")
    return owners.join(lists, "stage_run_id").select(
        "run_id", "stage_run_id", "stage", F.concat(F.lit("["), "gates", F.lit("]")).alias("gates")
    )


def _expired(runs: DataFrame, cutoff: dt.datetime, target: str | None) -> DataFrame:
    old = runs.where(
        (F.col("kind") == "data") & (F.col("status") != "running") & F.col("finished_at").isNotNull()
        & (F.col("finished_at") < F.lit(cutoff))
    )
    return (old.where(F.col("target") == target) if target else old).select(F.col("id").alias("run_id"))


def prune(tables: Mapping[str, DataFrame], now: dt.datetime, older_than_days: int, target: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of runs, stage_runs, gate_runs and events, and how many rows of each go.

    Only finished runs of kind 'data' older than the limit go, with everything that hangs on them;
    a running one never does. Nothing is written: a dry run looks at the counts only.
    """
    runs, stages, gates, events = (tables[n] for n in ("runs", "stage_runs", "gate_runs", "events"))
    expired = broadcast_if_small(_expired(runs, now - dt.timedelta(days=older_than_days), target))
    expired_stages = stages.join(expired, "run_id", "left_semi").select(F.col("id").alias("stage_run_id"))
    run_key = expired.withColumnRenamed("run_id", "id")
    gone = {
        "runs": runs.join(run_key, "id", "left_semi"), "stage_runs": expired_stages,
        "gate_runs": gates.join(expired_stages, "stage_run_id", "left_semi"),
        "events": events.join(expired, "run_id", "left_semi"),
    }
    kept = {
        "runs": runs.join(run_key, "id", "left_anti"), "stage_runs": stages.join(expired, "run_id", "left_anti"),
        "gate_runs": gates.join(expired_stages, "stage_run_id", "left_anti"),
        "events": events.join(expired, "run_id", "left_anti"),
    }
    kept = {name: rows.select(*tables[name].columns) for name, rows in kept.items()}
    counts = None
    for name, rows in gone.items():
        one = rows.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def totals(runs: DataFrame, stage_runs: DataFrame, gate_runs: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger totals, one row per measure."""
    def one(df: DataFrame, name: str, measure) -> DataFrame:
        return df.agg(measure.alias("n")).select(F.lit(name).alias("measure"), "n")

    out = one(runs, "runs", F.count(F.lit(1)))
    out = out.unionByName(one(events, "events", F.count(F.lit(1))))
    out = out.unionByName(one(stage_runs, "stages_run", F.count(F.lit(1))))
    return out.unionByName(one(gate_runs, "gates_failed", F.count_if(F.col("status") == "failed")))


TEST_RECORD = (
    "stage string, status string, ran bigint, passed bigint, failed bigint, errored bigint, skipped bigint, "
    "tests array<struct<test:string,status:string,failures:bigint>>"
)


def tests_from_events(events: DataFrame, prefix: str = "test.") -> DataFrame:
    """One row per test result recorded inside event JSON; a record that cannot be read gives none."""
    recorded = events.where(F.col("kind").startswith(prefix)).withColumn("_d", F.from_json("data_json", TEST_RECORD))
    return recorded.select("run_id", "kind", F.col("_d.stage").alias("stage"), F.explode("_d.tests").alias("_t")).select(
        "run_id", "kind", "stage", "_t.*"
    )


def stage_durations(stage_runs: DataFrame) -> DataFrame:
    """Seconds per stage run; NULL while it runs."""
    seconds = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return stage_runs.select("run_id", F.col("id").alias("stage_run_id"), "stage", "status", "row_count", seconds.alias("seconds"))


def run_durations(stage_runs: DataFrame) -> DataFrame:
    """Wall seconds from a run's first stage start to its last stage end, and the seconds spent in stages."""
    timed = stage_durations(stage_runs).select("stage_run_id", "seconds")
    rows = stage_runs.join(timed, F.col("id") == F.col("stage_run_id")).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("seconds").alias("stage_seconds"),
        F.min("started_at").alias("_first"), F.max("finished_at").alias("_last"),
    )
    wall = F.unix_timestamp(F.col("_last").cast("timestamp")) - F.unix_timestamp(F.col("_first").cast("timestamp"))
    return rows.withColumn("wall_seconds", wall).drop("_first", "_last")


def reconcile(reported: DataFrame, recorded: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Where a report and the ledger disagree: rows on one side only, or with different values."""
    a = reported.select(*keys, *[F.col(v).alias(f"reported_{v}") for v in values], F.lit(True).alias("_a"))
    b = recorded.select(*keys, *[F.col(v).alias(f"recorded_{v}") for v in values], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"reported_{v}").eqNullSafe(F.col(f"recorded_{v}"))
    problem = (
        F.when(F.col("_a").isNull(), "not reported").when(F.col("_b").isNull(), "not recorded").when(differs, "differs")
    )
    return both.withColumn("problem", problem).where("problem is not null").drop("_a", "_b")


def batch_completeness(batches: DataFrame, expected_tables: int) -> DataFrame:
    """Tables and loaded tables per batch, and whether the batch is complete."""
    rows = batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(F.col("status") == "loaded").alias("loaded")
    )
    complete = (F.col("tables") == expected_tables) & (F.col("loaded") == expected_tables)
    return rows.withColumn("complete", complete)


def batch_problems(batches: DataFrame, expected_tables: int, at_least: int) -> list[str]:
    seen = batch_completeness(batches, expected_tables).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("complete")).alias("bad")
    ).first()
    problems = []
    if seen["n"] < at_least:
        problems.append(f"expected at least {at_least} batches, got {seen['n']}")
    if seen["bad"]:
        problems.append(f"{seen['bad']} batch(es) are incomplete")
    return problems


def unfinished(sends: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Sends that nothing ended."""
    return sends.join(ends.select(key), key, "left_anti")


def send_outcomes(sends: DataFrame, ends: DataFrame, key: str, segment: str, outcome: str) -> DataFrame:
    """Counts of sends by segment, ends by outcome, and unfinished sends, one row each. An end without an
    outcome (resolved by hand) finishes its send but counts as no outcome."""
    a = sends.groupBy(segment).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("sent").alias("measure"), F.col(segment).cast("string").alias("name"), "n")
    b = ends.where(F.col(outcome).isNotNull()).groupBy(outcome).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("outcome").alias("measure"), F.col(outcome).cast("string").alias("name"), "n")
    c = unfinished(sends, ends, key).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("unfinished").alias("measure"), F.lit("all").alias("name"), "n")
    return a.unionByName(b).unionByName(c)


def newest_unmatched(failures: DataFrame, limit: int = 20) -> DataFrame:
    """The newest failures that no rule matched: the list to write rules from."""
    return failures.where("not matched").orderBy(F.desc("id")).limit(limit)
