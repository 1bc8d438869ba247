"""What the text operators share: typed slices of bounded size, stored intermediate tables, range buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sluiceway.llm
from sluiceway.session import scratch_path

# Functions of this subpackage travel to the executors by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(sluiceway.llm)

# Arrow batches end after this many bytes, and the functions below work on slices of this many bytes of text,
# so that a task's memory follows its longest text and not the number of rows.
BATCH_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
# What a row counts besides its text, so that a slice of many short texts is bounded as well.
ROW_BYTES = 512

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}

Columns = dict[str, list]


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, read with bounded Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text reads as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def arrow_schema(schema: str) -> pa.Schema:
    pairs = (field.strip().split(" ") for field in schema.split(","))
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in pairs])


def cuts(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size + ROW_BYTES > limit:
            yield start, i
            start, held = i, 0
        held += size + ROW_BYTES
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterable[pa.RecordBatch], sized_by: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(sized_by))), 0).to_pylist()
        for lo, hi in cuts(sizes, limit):
            yield batch.slice(lo, hi - lo)


def columns_of(batch: pa.RecordBatch) -> Columns:
    return {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}


def map_slices(df: DataFrame, start: Callable[[], Callable[[Columns], Columns]], schema: str, sized_by: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply a function from columns to columns to slices of bounded size. `start` runs once in each task
    and returns the function, so automata and models are built once."""
    target = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches, sized_by, limit):
            out = work(columns_of(part))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared scratch folder and read back; survives lost executors and cuts the lineage.

    Nothing reads the shuffles of this write again, so Spark deletes their files as soon as it is done."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"llm-{label}")
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the sorted `bounds` are at most `value`; compares with the square root of their number, twice."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [list(bounds[i:i + step]) for i in range(0, len(bounds), step)]

    def at_most(listed: Column) -> Column:
        return F.size(F.filter(listed, lambda bound: bound <= value))

    heads = F.array(*[F.lit(int(block[0])).cast("long") for block in blocks])
    rest = F.array(*[F.array(*[F.lit(int(b)).cast("long") for b in block]) for block in blocks])
    block = at_most(heads)
    inside = at_most(F.get(rest, F.greatest(block - 1, F.lit(0))))
    return F.when(value.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + inside)


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows of one key at a time, from batches sorted by an integer key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            part = batch.slice(lo, hi - lo)
            if held and held[0].column(part.schema.get_field_index(key))[0].as_py() != keys[lo]:
                yield joined(held)
                held = []
            held.append(part)
    if held:
        yield joined(held)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by an integer key, cut anew so that each holds all rows of its keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(key)
        keys = batch.column(at).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(edges):
            last = int(edges[-1])
            yield joined([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(at)[0].as_py() != keys[0]:
            yield joined(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


# --- hashing of words in numpy ---------------------------------------------------------------------------------------

GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash, equal in every process; forgets all once it holds too many words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def order_by(key: np.ndarray) -> np.ndarray:
    """Indices that sort 64-bit keys stably. Sorts the high bits packed with the index, which numpy does several
    times faster than an argsort, and falls back to that where equal high bits hide different keys."""
    n = len(key)
    bits = max(1, int(n - 1).bit_length()) if n else 1
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((key & ~low) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    high = packed & ~low
    same = high[1:] == high[:-1]
    if same.any():
        ordered = key[order]
        if (ordered[1:][same] != ordered[:-1][same]).any():
            return np.argsort(key, kind="stable")
    return order
