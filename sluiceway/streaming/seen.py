"""Unique keys across the micro-batches of a stream.

The keys of each batch are written once, as a folder of their own, and a record names it for the checkpoint, the gate and
the batch. Which keys repeat is then found by one narrow aggregate over the batch and one join with the keys of the batches
before it; no key is looked up on its own. A batch that runs again sees the keys of earlier batches only, and its newest
record replaces the one before.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.gates import Gate, Unique
from sluiceway.plans.store import TableStore
from sluiceway.records import append_records, read_records
from sluiceway.skew import broadcast_if_small, stored_side

SEEN = "namespace string, table string, checkpoint string, gate string, batch bigint, path string, seq bigint"


class MissingKeys(LookupError):
    """Keys of earlier batches of the stream were never recorded, so a unique gate cannot look back on them."""


class SeenKeys:
    """The keys one gate saw in each batch of one checkpoint."""

    def __init__(self, store: TableStore, namespace: str, table: str, checkpoint: str, gate: str):
        self.spark: SparkSession = store.spark
        self.records = f"{store.root}/_seen"
        self.folder = f"{store.root}/{namespace}/{table}_seen"
        self.names = {"namespace": namespace, "table": table, "checkpoint": checkpoint, "gate": gate}

    def add(self, batch: int, keys: DataFrame) -> DataFrame:
        path = f"{self.folder}/batch={batch:09d}-{uuid.uuid4().hex[:12]}"
        keys.write.parquet(path)
        append_records(self.spark, self.records, [{**self.names, "batch": batch, "path": path, "seq": time.time_ns()}], SEEN)
        return self.spark.read.schema(keys.schema).parquet(path)

    def before(self, batch: int, like: DataFrame) -> DataFrame | None:
        """The keys of all earlier batches, a key once for each batch it came in."""
        if batch == 0:
            return None
        mine = read_records(self.spark, self.records, SEEN).where(F.col("batch") < batch)
        for name, value in self.names.items():
            mine = mine.where(F.col(name) == value)
        newest = mine.groupBy("batch").agg(F.max_by("path", "seq").alias("path")).collect()
        if len(newest) != batch:
            raise MissingKeys(
                f"{self.names['namespace']}.{self.names['table']}: {batch - len(newest)} of the {batch} batches before have no keys of "
                f"gate {self.names['gate']}; start the stream from a new checkpoint"
            )
        return self.spark.read.schema(like.schema).parquet(*[r["path"] for r in newest])


class SeenBefore(Unique):
    """A unique gate that also rejects keys of earlier batches; `again` holds those that came before and come now."""

    def __init__(self, gate: Unique, seen: SeenKeys, batch: int):
        super().__init__(gate.table, list(gate.columns))
        object.__setattr__(self, "seen", seen)
        object.__setattr__(self, "batch", batch)
        object.__setattr__(self, "again", None)

    def repeated_keys(self, df: DataFrame) -> DataFrame:
        keys = list(self.columns)
        counted = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        now = self.seen.add(self.batch, counted)
        repeated = now.where("n > 1")
        earlier = self.seen.before(self.batch, now)
        if earlier is None:
            return repeated
        # The keys of one batch are different; those before it may be many and are filtered in place while these are few.
        again = earlier.join(broadcast_if_small(now.select(*keys)), keys, "left_semi").select(*keys).distinct()
        object.__setattr__(self, "again", stored_side(again, "seen-again"))
        return repeated.select(*keys).unionByName(self.again).distinct().withColumn("n", F.lit(2).cast("bigint"))


def placed_in_stream(gates: Sequence[Gate], store: TableStore, namespace: str, table: str, checkpoint: str, batch: int) -> list[Gate]:
    """The gates of one batch, with those that have to hold over all batches put in place."""
    return [
        SeenBefore(gate, SeenKeys(store, namespace, table, checkpoint, f"{number}: {', '.join(gate.columns)}"), batch)
        if isinstance(gate, Unique) and gate.table == table else gate
        for number, gate in enumerate(gates)
    ]
