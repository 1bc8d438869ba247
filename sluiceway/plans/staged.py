"""The staged run: build a stage, gate it, and go on only if every gate passed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sluiceway.gates import Gate, Quarantine, StageOutcome, run_gates
from sluiceway.gates.model import ROW_GATES, GateError
from sluiceway.ledger.store import Ledger
from sluiceway.plans.store import TableStore, Version, landing_namespace
from sluiceway.session import time_limit
from sluiceway.sources.jdbc import Incremental, load_table

LIMITS = ("extract", "transform", "gate")
# Seconds for a part that has no limit of its own while the other part of its stage has one.
DEFAULT_LIMITS = {"extract": 600, "transform": 300, "gate": 120}
Model = Callable[[Mapping[str, DataFrame]], DataFrame] | str


def build_models(tables: Mapping[str, DataFrame], models: Mapping[str, Model]) -> dict[str, DataFrame]:
    """Models in order, each seeing the tables and models before it: a function, or SQL with `{name}` references."""
    known = dict(tables)
    built = {}
    for name, model in models.items():
        if callable(model):
            built[name] = model(known)
        else:
            spark = next(iter(known.values())).sparkSession
            built[name] = spark.sql(model, **{k: v for k, v in known.items() if "{" + k + "}" in model})
        known[name] = built[name]
    return built


@dataclass(frozen=True)
class Stage:
    name: str
    models: Mapping[str, Model]
    gates: Sequence[Gate] = ()
    quarantine: Quarantine | None = None
    namespace: str | None = None
    depends_on: str | None = None


@dataclass(frozen=True)
class Flow:
    """Sources land as they are; the stages follow in order, each on the tables of all stages before it.

    Sources named in `incremental` land by merge: like the source itself, their landing copy moves on
    before the landing gates judge it. `limits` bounds a run's parts in seconds: extract, transform, gate;
    a stage is bounded when both of its parts are.
    """

    name: str
    sources: Mapping[str, Callable[[SparkSession], DataFrame]]
    stages: Sequence[Stage]
    landing_gates: Sequence[Gate] = ()
    landing_quarantine: Quarantine | None = None
    landing: str | None = None
    incremental: Mapping[str, Incremental] = field(default_factory=dict)
    limits: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if set(self.incremental) - set(self.sources):
            raise GateError(f"{self.name}: incremental names unknown source(s) {sorted(set(self.incremental) - set(self.sources))}")
        if self.incremental and self.landing_quarantine is not None:
            raise GateError(f"{self.name}: a landing table that is merged cannot be quarantined; gate the next stage")
        if set(self.limits) - set(LIMITS):
            raise GateError(f"{self.name}: unknown limit(s) {sorted(set(self.limits) - set(LIMITS))}; known are {LIMITS}")
        seen = ["landing"]
        for stage in self.stages:
            if stage.name in seen:
                raise GateError(f"{self.name}: stage {stage.name!r} is declared twice")
            if stage.depends_on is not None and stage.depends_on not in seen:
                raise GateError(f"{self.name}/{stage.name}: depends_on {stage.depends_on!r} is not an earlier stage")
            seen.append(stage.name)
        known = set(self.sources)
        _check_tables(self.name, "landing", self.landing_gates, known)
        for stage in self.stages:
            known |= set(stage.models)
            _check_tables(self.name, stage.name, stage.gates, known)


def _check_tables(flow: str, stage: str, gates: Sequence[Gate], known: set[str]) -> None:
    for gate in gates:
        named = {gate.table} if hasattr(gate, "table") else set(gate.tables)
        if named - known:
            raise GateError(f"{flow}/{stage}: {gate.kind} names unknown table(s) {sorted(named - known)}")


@dataclass
class FlowRun:
    run_id: int
    status: str
    outcomes: dict[str, StageOutcome] = field(default_factory=dict)
    problem: str = ""


def run_flow(
    spark: SparkSession, flow: Flow, store: TableStore, ledger: Ledger | None = None, now: dt.datetime | None = None,
    full_refresh: bool = False,
) -> FlowRun:
    """Run every stage until one fails. A full refresh lands incremental sources whole, deletions included.

    A failed stage is not published, so later stages and readers keep the last good version; the
    rows its gates rejected are in quarantine all the same. Nothing is held on the driver but counts.
    """
    ledger = ledger or Ledger(spark, f"{store.root}/_ledger")
    run_id = ledger.start_run("data", flow.name)
    run = FlowRun(run_id, "ok")
    known: dict[str, DataFrame] = {}
    land = Stage("landing", {}, flow.landing_gates, flow.landing_quarantine, landing_namespace(flow.name, flow.landing))
    for stage in (land, *flow.stages):
        stage_id = ledger.start_stage(run_id, flow.name, stage.name)
        try:
            # A model is only worked out while its gates run, so a later stage shares one limit for both.
            parts = ("extract", "gate") if stage is land else ("transform", "gate")
            limit = sum(flow.limits.get(k, DEFAULT_LIMITS[k]) for k in parts) if any(k in flow.limits for k in parts) else None
            with time_limit(spark, limit, f"{flow.name}/{stage.name}"):
                if stage is land:
                    built = {t: read(spark) for t, read in flow.sources.items()}
                else:
                    built = build_models(known, stage.models)
                landed = _land(flow, stage, built, store, run_id, full_refresh) if stage is land else None
                outcome = _run_stage(flow, stage, built, landed, known, store, ledger, run_id, now)
        except Exception as exc:
            run.status, run.problem = "failed", f"{type(exc).__name__}: {exc}"
            ledger.finish_stage(stage_id, "failed", run.problem)
            break
        run.outcomes[stage.name] = outcome
        problems = "; ".join(outcome.failures)
        ledger.finish_stage(
            stage_id, "passed" if outcome.passed else "failed", f"halted: {problems}" if problems else "gates passed",
            outcome.results, outcome.row_counts,
        )
        if not outcome.passed:
            run.status, run.problem = "failed", problems
            break
        known.update({t: outcome.tables[t] for t in outcome.tables})
    ledger.finish_run(run_id, run.status)
    return run


def _land(flow, stage, built, store, run_id, full_refresh) -> dict[str, int]:
    """Merge the incremental sources; returns how many rows this run took from each."""
    return {
        table: load_table(store, stage.namespace, table, built[table], str(run_id), rule, full_refresh)["extracted"]
        for table, rule in flow.incremental.items()
    }


def _run_stage(flow, stage, built, landed, known, store, ledger, run_id, now) -> StageOutcome:
    namespace, version, merged = stage.namespace or flow.name, str(run_id), landed or {}
    # A landing table is read from its source once: later scans, gates and stages use the stored copy.
    # A model is written by the gate pass when it has row gates, and here otherwise.
    staged, ready = {}, {}
    gated = {g.table for g in stage.gates if isinstance(g, ROW_GATES)}
    for table, df in built.items():
        if table in merged:
            ready[table] = store.read(namespace, table)
        elif table in gated and stage.quarantine is not None and stage.models:
            ready[table] = df
        else:
            staged[table] = store.stage(namespace, table, df, version)
            ready[table] = store.read_version(staged[table])
    if landed is not None:
        moved = {t: merged[t] if t in merged else staged[t].rows for t in built}
        ledger.event(run_id, "info", "extract.done", f"{flow.name}/{stage.name} extracted {moved}", moved)
    outcome = run_gates(
        {**known, **ready}, stage.gates, stage.quarantine, run_id, now,
        previous_counts=ledger.last_counts(flow.name, stage.name),
        write_to=lambda table: store.path_for(namespace, table, f"{version}-gated"),
    )
    for table, bad in outcome.rejected.items():
        store.add_rejected(namespace, table, bad, version)
    outcome.row_counts = {
        t: outcome.row_counts[t] if t in outcome.row_counts else merged[t] if t in merged else staged[t].rows for t in built
    }
    if outcome.passed:
        for table, path in outcome.paths.items():
            schema, rows = outcome.tables[table].schema.json(), outcome.row_counts.get(table, 0)
            staged[table] = Version(namespace, table, version, path, schema, rows)
        publish = [staged[t] for t in built if t not in merged]
        if publish:
            store.publish(publish)
    return outcome
