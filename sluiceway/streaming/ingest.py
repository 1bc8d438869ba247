"""Arriving files through gates into a merged landing table.

The stream's checkpoint remembers which files were read, so no cursor has to be stored. Each
micro-batch is gated and merged by the functions of the scheduled path. A published version carries the
checkpoint's own id and the batch number: a batch that was published and is replayed from the same
checkpoint is skipped, and everything a new checkpoint reads is merged, which changes nothing for
rows that have landed before. A new checkpoint quarantines what it reads again once more.

A unique gate holds for the whole stream: a key's copies are counted over all batches (see `seen`). When a copy comes
later, it is rejected, and the one that has landed is moved to quarantine in the same publish. A referential gate may
name tables that have landed already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluiceway.gates import Gate, Quarantine, run_gates
from sluiceway.gates.model import rejected_with_reason
from sluiceway.operators.merge import latest_versions
from sluiceway.plans.store import TableStore
from sluiceway.streaming.seen import SeenBefore, placed_in_stream


class GateFailed(RuntimeError):
    """A micro-batch was refused; landing still holds the last good version."""


def file_stream(
    spark: SparkSession, directory: str, schema: T.StructType, file_format: str = "parquet",
    name_filter: str = "*", files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format).option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(directory)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the checkpoint when it was made; it stays the same when the stream is started again from it."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def ingest(
    stream: DataFrame,
    store: TableStore,
    namespace: str,
    table: str,
    keys: Sequence[str],
    cursor: str,
    checkpoint: str,
    gates: Sequence[Gate] = (),
    quarantine: Quarantine | None = None,
    parents: Mapping[str, tuple[str, str]] | None = None,
) -> StreamingQuery:
    """Start a run over everything that has arrived; it stops by itself when that is done.

    `parents` names tables of the store, as (namespace, table), that the gates may refer to."""

    def each(batch: DataFrame, batch_id: int) -> None:
        started = checkpoint_id(batch.sparkSession, checkpoint)
        origin = f"batch-{started}-"
        version = f"{origin}{batch_id:09d}"
        landed = store.current(namespace, table)
        if landed is not None and landed.version.startswith(origin) and landed.version >= version:
            return
        known = {name: store.read(*where) for name, where in (parents or {}).items()}
        placed = placed_in_stream(gates, store, namespace, table, started, batch_id) if quarantine else list(gates)
        batch = batch.persist()
        try:
            outcome = run_gates({**known, table: batch}, placed, quarantine, run_id=batch_id)
            for name, bad in outcome.rejected.items():
                store.add_rejected(namespace, name, bad, version)
            if not outcome.passed:
                raise GateFailed("; ".join(outcome.failures))
            clean = outcome.tables[table]
            if landed is None:
                store.publish([store.stage(namespace, table, latest_versions(clean, keys, cursor), version, keys, cursor)])
                return
            rest = store.read_version(landed)
            recalled = None
            for gate in placed:
                if not isinstance(gate, SeenBefore) or gate.again is None:
                    continue
                moved = rejected_with_reason(rest.join(gate.again, list(gate.columns), "left_semi").select(*rest.columns), F.lit(gate.reason), batch_id)
                recalled = moved if recalled is None else recalled.unionByName(moved)
                rest = rest.join(gate.again, list(gate.columns), "left_anti").select(*rest.columns)
            if recalled is not None:
                store.add_rejected(namespace, table, recalled, f"{version}-recalled")
            store.merge(landed, clean, version, rest if recalled is not None else None)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
