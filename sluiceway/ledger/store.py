"""Appending to the ledger. A change of state is a new row; the row with the highest `seq` is the state."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.ledger import reports
from sluiceway.records import append_records, read_records

SCHEMAS = {
    "runs": "id bigint, kind string, target string, status string, meta_json string, started_at timestamp_ntz, "
            "finished_at timestamp_ntz, seq bigint",
    "stage_runs": "id bigint, run_id bigint, pipeline string, stage string, status string, row_count bigint, "
                  "counts_json string, started_at timestamp_ntz, finished_at timestamp_ntz, seq bigint",
    "gate_runs": "id bigint, stage_run_id bigint, gate_type string, status string, rows_checked bigint, "
                 "rows_rejected bigint, detail string, ts timestamp_ntz, seq bigint",
    "events": "id bigint, run_id bigint, ts timestamp_ntz, level string, kind string, actor string, message string, "
              "data_json string, seq bigint",
}
GENERATIONS = "generation bigint"


def latest_state(records: DataFrame, key: str = "id") -> DataFrame:
    """The newest record of each id, combined before the shuffle."""
    newest = records.groupBy(key).agg(F.max_by(F.struct("*"), "seq").alias("_r"))
    return newest.select("_r.*").drop("seq")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Ledger:
    """One writer at a time. Ids grow with time, so the newest run has the highest id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._open: dict[int, dict] = {}
        self._last = 0
        newest = read_records(spark, f"{self.root}/_generations", GENERATIONS).agg(F.max("generation")).first()[0]
        self._generation = newest or 0

    def _path(self, table: str, generation: int | None = None) -> str:
        return f"{self.root}/g={self._generation if generation is None else generation}/{table}"

    def _next(self) -> int:
        self._last = max(time.time_ns(), self._last + 1)
        return self._last

    def _append(self, table: str, *rows: Mapping) -> None:
        append_records(self.spark, self._path(table), rows, SCHEMAS[table])

    def records(self, table: str) -> DataFrame:
        return read_records(self.spark, self._path(table), SCHEMAS[table])

    def table(self, name: str) -> DataFrame:
        """Current rows of a ledger table."""
        return latest_state(self.records(name))

    # ---- writes

    def _start(self, table: str, **values) -> int:
        new = self._next()
        self._open[new] = {"id": new, "status": "running", "started_at": _now(), **values}
        self._append(table, {**self._open[new], "seq": new})
        return new

    def _finish(self, table: str, row_id: int, **values) -> None:
        self._append(table, {**self._open.pop(row_id), "finished_at": _now(), "seq": self._next(), **values})

    def start_run(self, kind: str, target: str, meta: Mapping | None = None) -> int:
        return self._start("runs", kind=kind, target=target, meta_json=json.dumps(meta) if meta else None)

    def finish_run(self, run_id: int, status: str) -> None:
        self._finish("runs", run_id, status=status)

    def start_stage(self, run_id: int | None, pipeline: str, stage: str) -> int:
        return self._start("stage_runs", run_id=run_id, pipeline=pipeline, stage=stage)

    def finish_stage(
        self, stage_id: int, status: str, message: str, results: Iterable = (), counts: Mapping[str, int] | None = None
    ) -> None:
        """Every gate of a stage in order with an event for each, the stage's event, and its state.

        The state comes last: a stage that reads as finished has its gates on record.
        """
        stage, gates, events = self._open[stage_id], [], []

        def note(good: bool, kind: str, message: str, **data) -> None:
            events.append(self._event(stage["run_id"], "info" if good else "error", kind, message, {"stage_run_id": stage_id, **data}))

        for r in results:
            seq = self._next()
            gates.append({
                "id": seq, "seq": seq, "ts": _now(), "stage_run_id": stage_id, "gate_type": r.gate_type, "status": r.status, "detail": r.detail,
                "rows_checked": r.rows_checked, "rows_rejected": r.rows_rejected,
            })
            note(r.passed, f"gate.{r.status}", f"{r.gate_type} in {stage['stage']} of {stage['pipeline']}" + (f", {r.detail}" if r.detail else ""), gate_type=r.gate_type)
        note(status == "passed", f"stage.{status}", f"{stage['stage']} of {stage['pipeline']}: {message}")
        if gates:
            self._append("gate_runs", *gates)
        self._append("events", *events)
        self._finish(
            "stage_runs", stage_id, status=status, row_count=sum(counts.values()) if counts else None,
            counts_json=json.dumps(dict(counts)) if counts else None,
        )

    def _event(self, run_id, level: str, kind: str, message: str, data: Mapping | None, actor: str = "engine") -> dict:
        seq = self._next()
        return {
            "id": seq, "run_id": run_id, "ts": _now(), "level": level, "kind": kind, "actor": actor, "message": message,
            "data_json": json.dumps(data) if data else None, "seq": seq,
        }

    def event(self, run_id: int | None, level: str, kind: str, message: str, data: Mapping | None = None, actor: str = "engine") -> None:
        self._append("events", self._event(run_id, level, kind, message, data, actor))

    def last_counts(self, pipeline: str, stage: str) -> dict[str, int]:
        """Rows per table of the last finished run of a stage, passed or failed."""
        mine = self.records("stage_runs").where(
            (F.col("pipeline") == pipeline) & (F.col("stage") == stage) & F.col("counts_json").isNotNull()
        )
        newest = mine.agg(F.max_by("counts_json", "seq").alias("c")).first()["c"]
        return json.loads(newest) if newest else {}

    def prune(
        self, older_than_days: int, target: str | None = None, dry_run: bool = False, now: dt.datetime | None = None
    ) -> dict[str, int]:
        """Drop finished runs older than the limit with all that hangs on them; returns rows dropped per table.

        What stays is written to a new generation of the ledger, as current states in few files, and
        one record makes that generation the ledger. A running run is never dropped.
        """
        kept, counts = reports.prune({n: self.table(n) for n in SCHEMAS}, now or _now(), older_than_days, target)
        dropped = {r["table"]: r["deleted"] for r in counts.collect()}
        if dry_run or not any(dropped.values()):
            return dropped
        new = self._generation + 1
        for name, rows in kept.items():
            # Later records of a row have a higher seq than its id, which is the time it was made.
            rows.withColumn("seq", F.col("id")).write.mode("overwrite").json(self._path(name, new))
        append_records(self.spark, f"{self.root}/_generations", [{"generation": new}], GENERATIONS)
        self._generation = new
        return dropped
