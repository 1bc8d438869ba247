"""All gates of a stage with one wide scan per table.

Which keys are repeated, orphaned or named by a rule is found first, from the key columns alone and
combined before the shuffle. Those key sets are written to shared scratch and measured; while they
are small they are broadcast, and the wide rows are flagged, counted and split into clean and
rejected in a single pass that shuffles nothing. A key set too large to broadcast is joined by
shuffle, with hot partitions split by adaptive execution; only rows that no gate has rejected yet take
part, and the result is stored before a later gate looks at it, so that no row is joined twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.gates.keys import fits, key_counts
from sluiceway.gates.model import (
    ROW_GATES, BusinessRule, Freshness, Gate, GateResult, NotNull, Quarantine, ReferentialIntegrity,
    RowCountBounds, SchemaContract, StageOutcome, Unique, count_verdict, crashed, freshness_verdict,
    rejected_with_reason, row_verdict, schema_verdict,
)
from sluiceway.gates.sequential import rule_rows
from sluiceway.session import cut_lineage, scratch_path
from sluiceway.skew import is_small, stored_side

# Number of the first gate that rejects the row; NULL while none does.
FLAG = "_rejected_by"
CLEAN = -1


@dataclass
class _Table:
    source: DataFrame
    flagged: DataFrame
    gates: list[int] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    newest: dict[int, dt.datetime | None] = field(default_factory=dict)
    # Whether `flagged` holds a join by shuffle that has not been stored, and whether it was ever stored.
    shuffles: bool = False
    stored: bool = False

    def settle(self) -> None:
        if self.shuffles:
            self.flagged, self.shuffles, self.stored = cut_lineage(self.flagged, "gate-flagged"), False, True

    @property
    def survivors(self) -> DataFrame:
        return self.flagged.where(F.col(FLAG).isNull()).drop(FLAG)


def flag_rows(df: DataFrame, gates: Sequence[Gate], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """`df` with the number of the first gate that rejects each row, NULL for clean rows."""
    state = _Table(df, df.withColumn(FLAG, F.lit(None).cast("int")))
    for number, gate in enumerate(gates):
        if not isinstance(gate, NotNull):
            state.settle()
        parents = {**(tables or {}), gate.table: state.survivors}
        state.flagged = _flag(state, gate, number, parents)[0]
    return state.flagged


def _flag(state: _Table, gate: Gate, number: int, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, int | None]:
    """The flagged table after one more gate, and a reject count that differs from the rows moved."""
    if isinstance(gate, NotNull):
        flag = F.when(F.col(FLAG).isNull() & gate.rejects(), number).otherwise(F.col(FLAG))
        return state.flagged.withColumn(FLAG, flag), None
    counted = None
    if isinstance(gate, Unique):
        columns, keys = list(gate.columns), gate.repeated_keys(state.survivors).drop("n")
    elif isinstance(gate, ReferentialIntegrity):
        # Being an orphan depends on the key alone, so rows earlier gates rejected need not be left out.
        children = state.survivors if state.stored else state.source
        columns, keys = [gate.column], gate.orphan_keys(children, tables[gate.references["table"]])
    else:
        ids = cut_lineage(rule_rows(gate, tables).toDF(gate.id_column), "gate-rule")
        counted = ids.count()
        columns, keys = [gate.id_column], ids.where(F.col(gate.id_column).isNotNull()).distinct()
    renamed = {c: f"_k{i}" for i, c in enumerate(columns)}
    side = stored_side(keys.withColumnsRenamed(renamed), "gate-keys")
    same = F.col(FLAG).isNull()
    for column, key in renamed.items():
        same = same & (F.col(column) == F.col(key))
    flag = F.when(F.col("_k0").isNotNull(), number).otherwise(F.col(FLAG))
    if is_small(side):
        return state.flagged.join(side, same, "left").withColumn(FLAG, flag).drop(*renamed.values()), counted
    state.shuffles = True
    still = state.flagged.where(F.col(FLAG).isNull()).join(side, same, "left").withColumn(FLAG, flag).drop(*renamed.values())
    return still.unionByName(state.flagged.where(F.col(FLAG).isNotNull())), counted


def run_gates(
    tables: Mapping[str, DataFrame],
    gates: Sequence[Gate],
    quarantine: Quarantine | None = None,
    run_id: int | None = None,
    now: dt.datetime | None = None,
    previous_counts: Mapping[str, int] | None = None,
    write_to: Callable[[str], str] | None = None,
) -> StageOutcome:
    """Same outcome as `run_gates_one_by_one`. Without a quarantine nothing is moved, only counted.

    `write_to` names the folder a split table is written to; scratch by default.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    states = {t: _Table(df, df.withColumn(FLAG, F.lit(None).cast("int"))) for t, df in tables.items()}
    early: dict[int, GateResult] = {}
    rule_counts: dict[int, int] = _keys_alone(tables, gates) if quarantine is None else {}
    for number, gate in enumerate(gates):
        try:
            if number in rule_counts:
                continue
            if isinstance(gate, SchemaContract):
                early[number] = schema_verdict(gate, {t: s.source for t, s in states.items()})
            elif isinstance(gate, ROW_GATES):
                if quarantine is not None and not isinstance(gate, NotNull):
                    used = {gate.table, gate.references["table"]} if isinstance(gate, ReferentialIntegrity) else states if isinstance(gate, BusinessRule) else {gate.table}
                    for t in used:
                        states[t].settle()
                # Lazy: each name means the rows that survived the gates before this one.
                state, seen = states[gate.table], {t: s.survivors for t, s in states.items()}
                if quarantine is None:
                    state = _Table(state.source, state.source.withColumn(FLAG, F.lit(None).cast("int")))
                    flagged, counted = _flag(state, gate, number, seen)
                    rejected = counted
                    if rejected is None:
                        rejected = flagged.where(F.col(FLAG).isNotNull()).count()
                    rule_counts[number] = rejected
                else:
                    states[gate.table].flagged, counted = _flag(state, gate, number, seen)
                    states[gate.table].gates.append(number)
                    if counted is not None:
                        rule_counts[number] = counted
            elif isinstance(gate, RowCountBounds):
                states[gate.table]
            elif isinstance(gate, Freshness):
                for t in gate.tables:
                    gate.newest(states[t].source)
        except Exception as exc:  # a gate that crashes is a failed gate; the others still run
            early[number] = crashed(gate, exc)

    clean, rejected, paths = {}, {}, {}
    named = {t for g in gates for t in ([g.table] if hasattr(g, "table") else g.tables)}
    for table, state in states.items():
        if table not in named:
            clean[table] = state.source
            continue
        path = write_to(table) if write_to else scratch_path(state.source.sparkSession, f"gate-{table}")
        clean[table], bad = _materialise(table, state, gates, early, run_id, path)
        if bad is not None:
            rejected[table] = bad
        if state.gates:
            paths[table] = f"{path}/{FLAG}={CLEAN}"

    results = [
        early[number] if number in early
        else _verdict(number, gate, gates, states, rule_counts, quarantine, now, previous_counts or {})
        for number, gate in enumerate(gates)
    ]
    return StageOutcome(results, clean, rejected, {t: s.counts["clean"] for t, s in states.items() if t in named}, paths)


def _keys_alone(tables: Mapping[str, DataFrame], gates: Sequence[Gate]) -> dict[int, int]:
    """Rejected rows of the unique and referential gates where nothing is moved, by one aggregate for each table. Gates of a
    table whose aggregate fails are left out: each of them is then tried, and fails, on its own."""
    counts: dict[int, int] = {}
    for table, df in tables.items():
        try:
            mine = {n: g for n, g in enumerate(gates) if isinstance(g, (Unique, ReferentialIntegrity)) and g.table == table and fits(g, df, tables)}
            counts |= key_counts(df, mine, tables)
        except (PySparkException, KeyError):
            continue
    return counts


def _materialise(table: str, state: _Table, gates: Sequence[Gate], early: Mapping[int, GateResult], run_id: int | None, path: str):
    """One wide pass over a table: write clean and rejected rows apart. Counts are then read from the
    stored files' footers, so they describe exactly what was written."""
    spark = state.source.sparkSession
    fresh = [n for n, g in enumerate(gates) if isinstance(g, Freshness) and table in g.tables and n not in early]
    newest = [
        gates[n].newest(state.source, F.col(FLAG).isNull() | (F.col(FLAG) > n)).alias(f"t{n}") for n in fresh
    ]
    if not state.gates:
        seen = state.flagged.agg(F.count(F.lit(1)).alias("total"), *newest).first().asDict()
        state.counts = {"total": seen["total"], "clean": seen["total"]}
        state.newest = {n: seen[f"t{n}"] for n in fresh}
        return state.source, None

    watch, flagged = Observation(), state.flagged
    if newest:
        flagged = flagged.observe(watch, *newest)
    flagged.withColumn(FLAG, F.coalesce(FLAG, F.lit(CLEAN))).write.mode("overwrite").partitionBy(FLAG).parquet(path)
    state.newest = {n: watch.get[f"t{n}"] for n in fresh}
    schema = T.StructType([*state.source.schema.fields, T.StructField(FLAG, T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    sizes = {r[FLAG]: r["n"] for r in stored.groupBy(FLAG).agg(F.count(F.lit(1)).alias("n")).collect()}
    state.counts = {
        "total": sum(sizes.values()), "clean": sizes.get(CLEAN, 0), **{f"g{n}": sizes.get(n, 0) for n in state.gates},
    }
    clean = stored.where(F.col(FLAG) == CLEAN).select(*state.source.columns)
    if state.counts["clean"] == state.counts["total"]:
        return clean, None
    reason = F.lit(None).cast("string")
    for n in state.gates:
        reason = F.when(F.col(FLAG) == n, F.lit(gates[n].reason)).otherwise(reason)
    return clean, rejected_with_reason(stored.where(F.col(FLAG) != CLEAN), reason, run_id).drop(FLAG)


def _verdict(number, gate, gates, states, rule_counts, quarantine, now, previous) -> GateResult:
    if isinstance(gate, Freshness):
        return freshness_verdict(gate, {t: states[t].newest[number] for t in gate.tables}, now)
    state = states[gate.table]
    checked = state.counts["total"] - sum(state.counts[f"g{n}"] for n in state.gates if n < number)
    if isinstance(gate, RowCountBounds):
        return count_verdict(gate, checked, previous.get(gate.table))
    rejected = rule_counts[number] if number in rule_counts else state.counts[f"g{number}"]
    return row_verdict(gate, rejected, checked, quarantine)
