"""Violations of all key gates of one table, counted by one aggregate.

The key columns of every unique and every referential gate are grouped as grouping sets of one narrow projection, to which
the parents' keys are united. The table is read once for all gates, counts are combined before the only shuffle of rows, and
a hot key is one line of each task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.gates.model import ReferentialIntegrity, Unique

KeyGate = Unique | ReferentialIntegrity

# The id of a grouping set is a number with one bit for each column.
MOST_COLUMNS = 60


def parent_of(gate: ReferentialIntegrity, tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables[gate.references["table"]].select(gate.references["column"])


def fits(gate: KeyGate, df: DataFrame, tables: Mapping[str, DataFrame]) -> bool:
    """Whether a gate can share the aggregate: a foreign key has to have its parent's type."""
    if isinstance(gate, Unique):
        return True
    return df.select(gate.column).schema[0].dataType == parent_of(gate, tables).schema[0].dataType


def key_counts(df: DataFrame, gates: Mapping[int, KeyGate], tables: Mapping[str, DataFrame]) -> dict[int, int]:
    """For each gate by its number the rows it rejects when it alone looks at `df`.

    All copies of a repeated key count; keys that hold a NULL are neither repeated nor orphans.
    """
    if not gates:
        return {}
    shared = {c: f"_k{i}" for i, c in enumerate(sorted({c for g in gates.values() if isinstance(g, Unique) for c in g.columns}))}
    sets = {n: tuple(dict.fromkeys(shared[c] for c in g.columns)) if isinstance(g, Unique) else (f"_r{n}",) for n, g in gates.items()}
    foreign = {n: g for n, g in gates.items() if isinstance(g, ReferentialIntegrity)}
    columns = [*shared.values(), *[f"_r{n}" for n in foreign]]
    if len(columns) > MOST_COLUMNS:
        half = sorted(gates)[: len(gates) // 2]
        return key_counts(df, {n: gates[n] for n in half}, tables) | key_counts(df, {n: g for n, g in gates.items() if n not in half}, tables)
    rows = df.select(
        *[F.col(c).alias(k) for c, k in shared.items()], *[F.col(g.column).alias(f"_r{n}") for n, g in foreign.items()], F.lit(1).alias("_child")
    )
    for n, g in foreign.items():
        rows = rows.unionByName(parent_of(g, tables).toDF(f"_r{n}").withColumn("_child", F.lit(0)), allowMissingColumns=True)
    groups = rows.groupingSets(sorted(set(sets.values())), *columns).agg(
        F.grouping_id().alias("_set"), F.sum("_child").alias("_n"), F.min("_child").alias("_least")
    )

    def rejected(n: int, gate: KeyGate):
        hit = F.col("_set") == sum(1 << i for i, c in enumerate(reversed(columns)) if c not in sets[n])
        for c in sets[n]:
            hit = hit & F.col(c).isNotNull()
        # A group without a parent's row has no least value below one.
        hit = hit & ((F.col("_n") > 1) if isinstance(gate, Unique) else (F.col("_least") == 1))
        return F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias(f"g{n}")

    totals = groups.agg(*[rejected(n, g) for n, g in gates.items()]).first()
    return {n: totals[f"g{n}"] for n in gates}
