"""Proving a flow on a fixture: run it twice on known tables and compare with known results after each run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from sluiceway.gates.verdict import required_gate_problems
from sluiceway.operators.compare import Comparison, compare_expected
from sluiceway.plans.staged import Flow, FlowRun, run_flow
from sluiceway.plans.store import TableStore


@dataclass(frozen=True)
class Expected:
    """The rows a published table must hold, and optionally its row count and exact column types."""

    table: str
    rows: Sequence[Mapping]
    namespace: str | None = None
    columns: Mapping[str, str] | None = None
    row_count: int | None = None


@dataclass
class Validation:
    runs: list[FlowRun] = field(default_factory=list)
    comparisons: list[Comparison] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    @property
    def idempotent(self) -> bool:
        """Both runs gave exactly the expected rows; two runs that merely finish prove nothing."""
        return len(self.comparisons) == 2 and all(c.ok for c in self.comparisons)

    @property
    def ok(self) -> bool:
        return self.idempotent and not self.problems


def validate(
    spark: SparkSession, flow: Flow, fixture: Mapping[str, DataFrame], expected: Sequence[Expected], store: TableStore,
    required_gates: Sequence[Mapping] = (), now: dt.datetime | None = None,
) -> Validation:
    """Use an empty store: what it already holds would take part in row-count comparisons and merges."""
    report = Validation()
    missing = sorted(set(flow.sources) - set(fixture))
    if missing:
        report.problems.append(f"the fixture lacks source table(s) {missing}")
    stages = {"landing": (flow.landing_gates, flow.landing_quarantine is not None)}
    stages |= {s.name: (s.gates, s.quarantine is not None) for s in flow.stages}
    report.problems += required_gate_problems(stages, required_gates)
    if report.problems:
        return report
    seeded = replace(flow, sources={name: lambda _s, df=fixture[name]: df for name in flow.sources})
    for attempt in (1, 2):
        run = run_flow(spark, seeded, store, now=now)
        report.runs.append(run)
        if run.status != "ok":
            report.problems.append(f"run {attempt} {run.status}: {run.problem}")
            return report
        comparison = _compare(store, flow, expected)
        report.comparisons.append(comparison)
        if not comparison.ok:
            report.problems.append(f"run {attempt}: {comparison.detail}")
            return report
    return report


def _compare(store: TableStore, flow: Flow, expected: Sequence[Expected]) -> Comparison:
    results = {
        e.table: compare_expected(store.read(e.namespace or flow.name, e.table), e.rows, e.columns, e.row_count)
        for e in expected
    }
    bad = {t: r for t, r in results.items() if not r.ok}
    return Comparison(not bad, "; ".join(f"{t}: {r.detail}" for t, r in (bad or results).items()))
