"""Gates run one after the other, each on the table the earlier ones left: the definition of the result.

Every row gate scans its table again and writes apart what it keeps and what it moves, so that the next one reads rows and
joins nothing again. `fused.run_gates` gives the same outcome in one wide scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.gates.model import (
    BusinessRule, Freshness, Gate, GateResult, NotNull, Quarantine, ReferentialIntegrity, RowCountBounds,
    SchemaContract, StageOutcome, Unique, count_verdict, crashed, freshness_verdict, rejected_with_reason,
    row_verdict, schema_verdict,
)
from sluiceway.session import cut_lineage, scratch_path

REJECTED = "_rejected"


def run_gates_one_by_one(
    tables: Mapping[str, DataFrame],
    gates: Sequence[Gate],
    quarantine: Quarantine | None = None,
    run_id: int | None = None,
    now: dt.datetime | None = None,
    previous_counts: Mapping[str, int] | None = None,
) -> StageOutcome:
    current = dict(tables)
    moved: dict[str, list[DataFrame]] = {}
    results: list[GateResult] = []
    for gate in gates:
        try:
            results.append(_run(gate, current, moved, quarantine, run_id, now, previous_counts or {}))
        except Exception as exc:  # a gate that crashes is a failed gate; the others still run
            results.append(crashed(gate, exc))
    rejected = {}
    for table, parts in moved.items():
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        rejected[table] = out
    named = {t for g in gates for t in ([g.table] if hasattr(g, "table") else g.tables)}
    counts = {t: df.count() for t, df in current.items() if t in named}
    return StageOutcome(results, current, rejected, counts)


def _run(gate, current, moved, quarantine, run_id, now, previous) -> GateResult:
    if isinstance(gate, SchemaContract):
        return schema_verdict(gate, current)
    if isinstance(gate, Freshness):
        newest = {t: current[t].agg(gate.newest(current[t])).first()[0] for t in gate.tables}
        return freshness_verdict(gate, newest, now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    if isinstance(gate, RowCountBounds):
        return count_verdict(gate, current[gate.table].count(), previous.get(gate.table))

    df = current[gate.table]
    total = df.count()
    marked, found = _marked(gate, df, current)
    if quarantine is None:
        rejected = marked.where(F.col(REJECTED)).count() if found is None else found
        return row_verdict(gate, rejected, total, quarantine)
    kept, bad = _apart(marked, df.columns)
    rejected = bad.count() if found is None else found
    if rejected:
        current[gate.table] = kept
        moved.setdefault(gate.table, []).append(rejected_with_reason(bad, F.lit(gate.reason), run_id))
    return row_verdict(gate, rejected, total, quarantine)


def _marked(gate: Gate, df: DataFrame, current: Mapping[str, DataFrame]) -> tuple[DataFrame, int | None]:
    """The rows with a mark on those to reject, and a reject count that differs from the rows marked."""
    if isinstance(gate, NotNull):
        return df.withColumn(REJECTED, gate.rejects()), None
    if isinstance(gate, Unique):
        return _by_keys(df, gate.repeated_keys(df).drop("n")), None
    if isinstance(gate, ReferentialIntegrity):
        return _by_keys(df, gate.orphan_keys(df, current[gate.references["table"]])), None
    if isinstance(gate, BusinessRule):
        rows = cut_lineage(rule_rows(gate, current).toDF(gate.id_column), "gate-rule")
        # What the rule returned is counted, not what is moved: an id may come twice, or be NULL.
        return _by_keys(df, rows.distinct()), rows.count()
    raise TypeError(f"no row-level rejection for {gate!r}")


def _by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with a mark on those whose key is listed; the listed keys are different."""
    marked = df.join(keys.withColumn(REJECTED, F.lit(True)), keys.columns, "left")
    return marked.select(*df.columns, F.coalesce(REJECTED, F.lit(False)).alias(REJECTED))


def _apart(marked: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without the mark and rows with it, each stored once."""
    path = scratch_path(marked.sparkSession, "gate-apart")
    marked.write.partitionBy(REJECTED).parquet(path)
    stored = marked.sparkSession.read.schema(marked.schema).parquet(path)
    return stored.where(~F.col(REJECTED)).select(*columns), stored.where(REJECTED).select(*columns)


def rule_rows(gate: BusinessRule, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The first column of the rule's result, with the stage's tables visible under their own names.

    The names are bound when the rule is parsed; temporary views of the caller are put back after.
    """
    spark = tables[gate.table].sparkSession
    catalog = spark.catalog
    own = {n: spark.table(n) for n in tables if catalog.tableExists(n) and catalog.getTable(n).isTemporary}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        rows = spark.sql(gate.sql)
        return rows.select(rows.columns[0])
    finally:
        for name in tables:
            catalog.dropTempView(name)
        for name, df in own.items():
            df.createOrReplaceTempView(name)
