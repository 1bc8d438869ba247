"""Versioned tables on plain files.

A table version is one folder that never changes, written by one job under one schema. What is current is decided by
publish records: one small file names every table of a publish, so several tables change together or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.merge import merge_changes
from sluiceway.operators.widen import TypeConflict, common_schema, under_schema, widest
from sluiceway.records import append_records, read_records
from sluiceway.session import scratch_path

PUBLISHED = (
    "namespace string, table string, version string, path string, schema string, rows bigint, "
    "keys array<string>, cursor string, high string, seq bigint"
)
REJECTED = "namespace string, table string, run string, schema string, seq bigint"


@dataclass(frozen=True)
class Version:
    """A publish record. `high` is the highest cursor value as text, and `merged` (not stored) the rows of the merge
    that made this version."""

    namespace: str
    table: str
    version: str
    path: str
    schema: str
    rows: int
    keys: tuple[str, ...] = ()
    cursor: str | None = None
    high: str | None = None
    seq: int = 0
    merged: int = 0

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def landing_namespace(flow_name: str, override: str | None = None) -> str:
    return override or f"{flow_name}_landing"


class TableStore:
    """One writer per namespace at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path_for(self, namespace: str, table: str, version: str, kind: str = "v") -> str:
        """A folder of its own for every attempt to write, so that nothing published is ever written to."""
        return f"{self.root}/{namespace}/{table}/{kind}={version}-{uuid.uuid4().hex[:12]}"

    # ---- reading

    def records(self) -> DataFrame:
        return read_records(self.spark, f"{self.root}/_published", PUBLISHED)

    def current(self, namespace: str, table: str) -> Version | None:
        """The newest publish record of a table, or None."""
        return self.current_tables(namespace, [table]).get(table)

    def current_tables(self, namespace: str, tables: Sequence[str]) -> dict[str, Version]:
        """The newest publish records of those of the tables that have one."""
        mine = self.records().where((F.col("namespace") == namespace) & F.col("table").isin(list(tables)))
        found = mine.groupBy("table").agg(F.max_by(F.struct("*"), "seq").alias("r")).collect()
        records = [row["r"].asDict() for row in found]
        return {r["table"]: Version(**{**r, "keys": tuple(r["keys"] or ())}) for r in records}

    def read(self, namespace: str, table: str) -> DataFrame:
        version = self.current(namespace, table)
        if version is None:
            raise LookupError(f"{namespace}.{table} has never been published")
        return self.read_version(version)

    def read_version(self, version: Version) -> DataFrame:
        if version.rows == 0:
            return self.spark.createDataFrame([], version.struct)
        return self.spark.read.schema(version.struct).parquet(version.path)

    # ---- writing

    def write(self, path: str, df: DataFrame, keys: Sequence[str] = (), cursor: str | None = None) -> tuple[int, str | None]:
        """Write one new directory. Returns its rows and highest cursor value; a NULL key or cursor is refused by name."""
        seen = Observation()
        measures = [F.count(F.lit(1)).alias("n")]
        needed = [*keys, *([cursor] if cursor else [])]
        if cursor:
            measures.append(F.max(cursor).cast("string").alias("high"))
        measures += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(needed)]
        df.observe(seen, *measures).write.parquet(path)
        missing = {c: seen.get[f"null_{i}"] for i, c in enumerate(needed) if seen.get[f"null_{i}"]}
        if missing:
            raise ValueError(f"rows without a value cannot be merged: {missing} (column: rows) in {path}")
        return seen.get["n"], seen.get.get("high")

    def publish(self, versions: Sequence[Version]) -> None:
        """Make versions current, all of them by one record file."""
        seq = time.time_ns()
        rows = [asdict(replace(v, seq=seq)) for v in versions]
        append_records(self.spark, f"{self.root}/_published", rows, PUBLISHED)

    def stage(
        self, namespace: str, table: str, df: DataFrame, version: str,
        keys: Sequence[str] = (), cursor: str | None = None,
    ) -> Version:
        """Write a full table version without publishing it."""
        path = self.path_for(namespace, table, version)
        rows, high = self.write(path, df, keys, cursor)
        return Version(namespace, table, version, path, df.schema.json(), rows, keys=tuple(keys), cursor=cursor, high=high)

    def replace(self, namespace: str, tables: Mapping[str, DataFrame], version: str) -> dict[str, int]:
        """Write and publish full replacements; returns rows per table."""
        staged = [self.stage(namespace, t, df, version) for t, df in tables.items()]
        self.publish(staged)
        return {v.table: v.rows for v in staged}

    def merge(
        self, old: Version, delta: DataFrame, version: str, rest: DataFrame | None = None, along: Sequence[Version] = (),
    ) -> Version:
        """Merge changed rows into the current version of a table that has keys and a cursor, as one new version.

        Columns may be new, and their types may grow (see `widen`): the old rows are then read under the wider type, so
        one version has one schema. A column that is gone, or whose types have nothing in common, is refused by name
        before anything is written. While the changed keys fit a broadcast the old rows are copied without a shuffle.
        `rest` may stand for the old rows, with some of them taken out. Staged versions `along` are published with it.
        """
        if not old.keys or old.cursor is None:
            raise LookupError(f"{old.namespace}.{old.table} was not published with keys and a cursor")
        known = {c.lower() for c in delta.columns}
        gone = [c for c in old.struct.names if c.lower() not in known]
        if gone:
            raise ValueError(f"{old.namespace}.{old.table}: the source no longer has column(s) {gone}; load it in full")
        try:
            schema = common_schema(old.struct, delta.schema, keep=[old.cursor])
        except TypeConflict as exc:
            raise TypeConflict(f"{old.namespace}.{old.table}: {exc}; load it in full") from None
        # Written apart first, so that the source is read once and its rows are measured before they are merged.
        changes = scratch_path(self.spark, "changes")
        rows, _ = self.write(changes, under_schema(delta, schema), old.keys, old.cursor)
        if rows == 0 and rest is None:
            return old
        base = under_schema(self.read_version(old) if rest is None else rest, schema)
        merged = merge_changes(base, self.spark.read.schema(schema).parquet(changes), old.keys, old.cursor)
        new = self.stage(old.namespace, old.table, merged, version, old.keys, old.cursor)
        self.publish([new, *along])
        return replace(new, merged=rows)

    # ---- quarantine: one directory per run, so a repeated run replaces its own rows only

    def quarantine_path(self, namespace: str, table: str) -> str:
        return f"{self.root}/{namespace}/{table}_quarantine"

    def add_rejected(self, namespace: str, table: str, rejected: DataFrame, run: str) -> None:
        rejected.write.mode("overwrite").parquet(f"{self.quarantine_path(namespace, table)}/run={run}")
        record = {"namespace": namespace, "table": table, "run": run, "schema": rejected.schema.json(), "seq": time.time_ns()}
        append_records(self.spark, f"{self.root}/_rejected", [record], REJECTED)

    def read_rejected(self, namespace: str, table: str) -> DataFrame:
        """All rejected rows of all runs, each run's files under the schema they were written with and then under one that
        holds all; rows written under older table shapes keep NULL in newer columns."""
        mine = read_records(self.spark, f"{self.root}/_rejected", REJECTED).where((F.col("namespace") == namespace) & (F.col("table") == table))
        newest = mine.groupBy("run").agg(F.max_by("schema", "seq").alias("schema"), F.max("seq").alias("seq"))
        # One row for every table shape.
        shapes = newest.groupBy("schema").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.min("seq").alias("seq")).orderBy("seq").collect()
        if not shapes:
            raise LookupError(f"{namespace}.{table} has no rejected rows")
        schemas = [T.StructType.fromJson(json.loads(s["schema"])) for s in shapes]
        schema, path = widest(schemas), self.quarantine_path(namespace, table)
        parts = [
            under_schema(self.spark.read.schema(own).parquet(*[f"{path}/run={run}" for run in shape["runs"]]), schema)
            for own, shape in zip(schemas, shapes)
        ]
        return reduce(DataFrame.unionByName, parts)
