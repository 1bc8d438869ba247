"""CSV landing tables and seeds.

A file is read in splits by many tasks although quoted fields may hold line breaks. Whether a line begins inside quotes
depends on all lines before it, so every split is read twice. First each tells how it ends if it begins outside of
quotes, and if it begins inside: such functions of one bit are composed over the splits before (a prefix scan over a row
for each split). Then every split cuts its own lines into records, knowing how it begins. A record over the end of a
split is put together from its pieces.

Fields follow RFC 4180 as serial readers do: a quote opens a field only at its start, quotes within are doubled, and what
follows a closing quote is text. A line ends with a line feed; a carriage return before it does not count outside of
quotes. An empty field and a missing trailing field both read as NULL, and so does a column that a file does not have.
A blank line is no record. A record with more fields than its file's header is refused, or lands the rest in a column.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sluiceway.session import cut_lineage
from sluiceway.skew import is_small

# For seeds, which are small and read with Spark's own reader.
DIALECT = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
REST = "_rest"

# The functions below travel to the executors by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- one line and one record

def _closed(line: str, at: int) -> int:
    """Where the field goes on after the quote that closes it, from inside of quotes; -1 if none does."""
    while (at := line.find('"', at)) >= 0:
        if line[at + 1:at + 2] != '"':
            return at + 1
        at += 2
    return -1


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside of quotes, or at a field's start, ends inside of quotes."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line[at:at + 1] == '"':
            at = _closed(line, at if inside else at + 1)
            if at < 0:
                return True
            inside = False
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def fields_of(record: str) -> list[str]:
    """The fields of one whole record; an unclosed quote reaches to its end."""
    return next(csv.reader([record.removesuffix("\r")]), [])


# ---- splits

def split_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, at, value): the lines of every split, whose rows come in order within their partition."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _by_split(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Each split's constant columns with an iterator over its lines, which must be read to the end."""
    rows = (row for batch in batches for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*names, "value"))))
    first = next(rows, None)
    while first is not None:
        key, following = first[:-1], []

        def lines(first=first, key=key, following=following) -> Iterator[str]:
            yield first[-1]
            for row in rows:
                if row[:-1] != key:
                    following.append(row)
                    return
                yield row[-1]

        yield key, lines()
        first = following[0] if following else None


SPLITS = "file string,at bigint,from_outside boolean,from_inside boolean,header string"


def describe_splits(lines: DataFrame) -> DataFrame:
    """One row per split: whether it ends inside of quotes if it begins outside or inside, and a file's header record."""

    def run(batches):
        for (file, at), values in _by_split(batches, ["file", "at"]):
            outside, inside, head, header = False, True, [], None
            for value in values:
                if '"' in value:
                    outside, inside = ends_inside(value, outside), ends_inside(value, inside)
                if at == 0 and header is None:
                    head.append(value)
                    if not outside:
                        header = "\n".join(head)
            yield pa.RecordBatch.from_pylist(
                [{"file": file, "at": at, "from_outside": outside, "from_inside": inside, "header": header}],
                schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_()), ("header", pa.string())]))

    return lines.mapInArrow(run, SPLITS)


def begin_splits(described: DataFrame) -> DataFrame:
    """(file, at, begins, ends, header): whether each split begins and ends inside of quotes.

    A split either sets the state, keeps it or turns it round; it begins in the last state set before it, turned round as
    often as splits since do so."""
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (~F.col("from_inside") & F.col("from_outside")).cast("int")
    sets = F.when(F.col("from_inside") == F.col("from_outside"), F.col("from_inside"))
    known = described.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.struct(sets.alias("to"), F.col("turned").alias("turned"))
    last = F.last(F.when(sets.isNotNull(), state), ignorenulls=True).over(before)
    upto = F.coalesce(F.sum(turns).over(before), F.lit(0))
    since = upto - F.coalesce(last["turned"], F.lit(0))
    begins = F.coalesce(last["to"], F.lit(False)).cast("int").bitwiseXOR((since % 2).cast("int")) == 1
    head = F.first("header", ignorenulls=True).over(Window.partitionBy("file"))
    placed = known.select("file", "at", "from_outside", "from_inside", begins.alias("begins"), head.alias("header"))
    return placed.select("file", "at", "begins", F.when(F.col("begins"), F.col("from_inside")).otherwise(F.col("from_outside")).alias("ends"), "header")


# ---- tables

def csv_files(spark: SparkSession, pattern: str) -> dict[str, list[str]]:
    """Table name (file stem) to the paths of every file a glob matches; no match is an error. Files of one stem, such as
    those of several folders, are one table."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*")
    try:
        paths = [r["path"] for r in listing.load(pattern).select("path").collect()]
    except AnalysisException as exc:
        raise FileNotFoundError(f"no files matched {pattern}") from exc
    if not paths:
        raise FileNotFoundError(f"no files matched {pattern}")
    tables: dict[str, list[str]] = {}
    for path in sorted(paths):
        tables.setdefault(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], []).append(path)
    return tables


def _header_columns(header: str) -> list[str]:
    columns = fields_of(header.removeprefix("\ufeff"))
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if twice:
        raise ValueError(f"a header names column(s) {twice} twice")
    return columns


def read_csv(spark: SparkSession, path: str | Sequence[str], land_rest: bool = False, file_col: str | None = None) -> DataFrame:
    """A file, or files and folders, as one table: all columns text, untrimmed, matched by name over the files' headers.

    With `land_rest` the fields beyond a header land in an array column `_rest`; otherwise they raise. `file_col` names
    a column for the file that a row comes from."""
    lines = split_lines(spark, [path] if isinstance(path, str) else path)
    splits = cut_lineage(begin_splits(describe_splits(lines)), "csv-splits")
    headers = [r.header for r in splits.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()]
    if not headers:
        raise FileNotFoundError(f"no rows and no header in {path}")
    known = {header: _header_columns(header) for header in headers}
    columns = list(dict.fromkeys(c for listed in known.values() for c in listed))
    place = {header: [columns.index(c) for c in listed] for header, listed in known.items()}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField(REST, T.ArrayType(T.StringType()))] * land_rest + [T.StructField(file_col or "", T.StringType())] * bool(file_col))
    target = pa.schema([(c, pa.string()) for c in columns] + [(REST, pa.list_(pa.string()))] * land_rest + [(file_col, pa.string())] * bool(file_col))

    def table_of(records: list[tuple[str, str, str]]) -> pa.RecordBatch:
        """Parsed records of (file, header, record)."""
        # Texts longer than the csv module's own limit are fields like others.
        csv.field_size_limit((1 << 31) - 1)
        rows = []
        for file, header, record in records:
            found, row = fields_of(record), [None] * len(columns)
            if not found:
                continue
            for at, value in zip(place[header], found):
                row[at] = value or None
            rest = found[len(place[header]):]
            if land_rest:
                row.append(rest or None)
            elif rest:
                raise ValueError(f"{file}: a record has {len(found)} fields under {len(place[header])} columns: {record[:200]!r}")
            rows.append(row + [file] if file_col else row)
        listed = zip(*rows) if rows else [[] for _ in target]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(listed, target)], schema=target)

    def whole_records(batches):
        """The records that begin and end within a split."""
        for (file, at, begins, header), values in _by_split(batches, ["file", "at", "begins", "header"]):
            inside, open_lines, held, done, skip = begins, [], 0, [], at == 0
            for value in values:
                ends = ends_inside(value, inside)
                if begins:
                    # The first record belongs to an earlier split.
                    begins = ends
                else:
                    open_lines.append(value)
                    if not ends:
                        if not skip:
                            done.append((file, header, open_lines[0] if len(open_lines) == 1 else "\n".join(open_lines)))
                            held += len(done[-1][2])
                        skip, open_lines = False, []
                inside = ends
                if held > 1 << 20 or len(done) >= 10_000:
                    yield table_of(done)
                    held, done = 0, []
            yield table_of(done)

    def pieces(batches):
        """The end of a record from earlier splits (part 0), and the beginning of one that goes on in later ones (part 1)."""
        for (file, at, begins, header), values in _by_split(batches, ["file", "at", "begins", "header"]):
            inside, part, found = begins, [], []
            open_at = 0 if begins else None
            for value in values:
                ends = ends_inside(value, inside)
                if not inside and ends:
                    part, open_at = [], 1
                if open_at is not None:
                    part.append(value)
                if inside and not ends:
                    if open_at == 0:
                        found.append((0, "\n".join(part)))
                    part, open_at = [], None
                inside = ends
            if inside:
                found.append((open_at, "\n".join(part)))
            yield pa.RecordBatch.from_pylist(
                [{"file": file, "header": header, "at": at, "part": p, "piece": text} for p, text in found],
                schema=pa.schema([("file", pa.string()), ("header", pa.string()), ("at", pa.int64()), ("part", pa.int64()), ("piece", pa.string())]))

    def parsed(batches):
        for batch in batches:
            yield table_of(list(zip(*(batch.column(i).to_pylist() for i in range(3)))))

    def with_state(chosen: DataFrame) -> DataFrame:
        if is_small(chosen):
            return lines.join(F.broadcast(chosen), ["file", "at"]).select("file", "at", "begins", "header", "value")
        # Too many splits to broadcast their states: lines go to their split's state, and are put in order again.
        joined = lines.withColumn("line", F.monotonically_increasing_id()).join(chosen, ["file", "at"])
        return joined.repartition("file", "at").sortWithinPartitions("file", "at", "line").select("file", "at", "begins", "header", "value")

    states = splits.select("file", "at", "begins", "header")
    table = with_state(states).mapInArrow(whole_records, schema)
    broken = splits.where("begins or ends").select("file", "at", "begins", "header")
    if broken.isEmpty():
        return table
    found = with_state(broken).mapInArrow(pieces, "file string,header string,at bigint,part bigint,piece string")
    started = Window.partitionBy("file").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, 0)
    grouped = found.withColumn("record", F.sum("part").over(started)).groupBy("file", "header", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "piece"))), lambda p: p["piece"]), "\n").alias("text"))
    return table.unionByName(grouped.select("file", "header", "text").mapInArrow(parsed, schema))


def csv_tables(spark: SparkSession, pattern: str, land_rest: bool = False) -> dict[str, DataFrame]:
    """One landing table for the matched files of each stem."""
    return {name: read_csv(spark, paths, land_rest) for name, paths in csv_files(spark, pattern).items()}


def read_seed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A lookup file with declared column types; a value of another type raises."""
    return spark.read.options(**DIALECT, enforceSchema="false").option("mode", "FAILFAST").schema(schema).csv(path)


def rows_per_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Row count per source file of a CSV table."""
    return read_csv(spark, path, land_rest=True, file_col="path").groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
