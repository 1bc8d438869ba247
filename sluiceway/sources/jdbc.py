"""Database tables through the JDBC reader: snapshots, and rows past a cursor."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.merge import DIGEST, latest_versions, missed_rows, not_seen, past_cursor, with_digest
from sluiceway.plans.store import TableStore, Version
from sluiceway.session import cut_lineage

# The schema a table lives in when none is named.
DEFAULT_SCHEMA = {"postgresql": "public", "sqlserver": "dbo"}


@dataclass(frozen=True)
class Incremental:
    """Load only rows whose `cursor` moved, and merge them on `primary_key`.

    With `look_back` (a time span, or a number for a numeric cursor) each load also reads so far behind the newest landed
    cursor, and lands what it has not read before: rows that were committed late. `count_missed` asks for the number of
    rows that came later still, for which each load reads the keys and cursors of all older rows.
    """

    cursor: str
    primary_key: Sequence[str]
    initial_value: int | str | dt.datetime | None = None
    look_back: int | dt.timedelta | None = None
    count_missed: bool = False

    def __post_init__(self):
        if not self.cursor or not str(self.cursor).strip():
            raise ValueError("incremental: cursor is required")
        keys = [self.primary_key] if isinstance(self.primary_key, str) else list(self.primary_key or [])
        if not keys or not all(isinstance(k, str) and k.strip() for k in keys):
            raise ValueError("incremental: primary_key is required, a column name or a list of them")
        object.__setattr__(self, "primary_key", tuple(keys))
        start = self.initial_value
        if isinstance(start, bool) or not (start is None or isinstance(start, (int, str, dt.date))):
            raise ValueError(f"incremental: initial_value {start!r} must be an integer or an ISO date-time")
        if isinstance(start, str):
            object.__setattr__(self, "initial_value", dt.datetime.fromisoformat(start))
        back = self.look_back
        if back is not None and (isinstance(back, bool) or not isinstance(back, (int, dt.timedelta)) or back < type(back)(0)):
            raise ValueError(f"incremental: look_back {back!r} must be a time span or an integer, and not negative")
        if self.count_missed and back is None:
            raise ValueError("incremental: count_missed needs look_back")


@dataclass(frozen=True)
class Partitioning:
    """Split a table read by ranges of a numeric, date or timestamp column, one task and connection per range."""

    column: str
    lower: str
    upper: str
    partitions: int


@dataclass(frozen=True)
class Database:
    """`url` and credentials as the JDBC reader takes them; keep secrets out of code and pass them in `options`."""

    url: str
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str | None = None
    fetch_rows: int = 50_000

    @property
    def dialect(self) -> str:
        return self.url.split(":")[1]

    def qualified(self, table: str) -> str:
        schema = self.schema or DEFAULT_SCHEMA.get(self.dialect)
        return f"{schema}.{table}" if schema else table

    def reader_options(self, table: str, split: Partitioning | None = None) -> dict[str, str]:
        options = {
            **self.options, "url": self.url, "dbtable": self.qualified(table), "fetchsize": str(self.fetch_rows),
            "preferTimestampNTZ": "true",
        }
        if split:
            options |= {
                "partitionColumn": split.column, "lowerBound": split.lower, "upperBound": split.upper,
                "numPartitions": str(split.partitions),
            }
        return options

    def read(self, spark: SparkSession, table: str, split: Partitioning | None = None) -> DataFrame:
        """The table as it is now. Filters and column choices on the result run in the database.

        Several connections see several snapshots; leave `split` out where one snapshot matters.
        """
        return spark.read.format("jdbc").options(**self.reader_options(table, split)).load()


    def read_cut(self, spark: SparkSession, keys: Mapping[str, str], ranges: int = 1) -> dict[str, DataFrame]:
        """Several tables as of one moment, named with the key column that new rows come with at its upper end.

        The largest keys of all tables are taken first, by one statement; whatever is read afterwards lies at or below
        them, so that rows added meanwhile are in no table. Rows changed or deleted meanwhile are not held back. Each
        table is read in `ranges` of about equal numbers of rows, as its database measures them, one connection each;
        rows without a key are in the first range.
        """
        def ask(query: str) -> DataFrame:
            options = {k: v for k, v in self.reader_options("").items() if k != "dbtable"}
            return spark.read.format("jdbc").options(**options, query=query).load()

        return read_cut(self, keys, ranges, ask, lambda table, predicates: spark.read.jdbc(
            self.url, self.qualified(table), predicates=predicates,
            properties={k: v for k, v in self.reader_options(table).items() if k not in ("url", "dbtable")},
        ))


def read_cut(database: Database, keys: Mapping[str, str], ranges: int, ask, read) -> dict[str, DataFrame]:
    """`Database.read_cut` with its two ways to the database: a query's rows, and a table's rows by predicates."""
    if ranges < 1:
        raise ValueError(f"{ranges} ranges")
    if not keys:
        return {}
    highs = ask(bounds_query(database, keys)).first()
    found = {}
    for n, (table, key) in enumerate(keys.items()):
        high, starts = highs[n], []
        if high is not None and ranges > 1:
            # In the order of the database, which for text need not be Python's.
            starts = [r[1] for r in sorted(ask(starts_query(database, table, key, high, ranges)).collect(), key=lambda r: r[0])]
        found[table] = read(table, range_predicates(key, high, starts, database.dialect))
    return found


def bounds_query(database: Database, keys: Mapping[str, str]) -> str:
    """The largest key of every table, as columns of one row: one statement sees all tables at one moment."""
    return "select " + ", ".join(
        f"(select max({quoted(key)}) from {database.qualified(table)}) as high_{n}" for n, (table, key) in enumerate(keys.items())
    )


def starts_query(database: Database, table: str, key: str, high, ranges: int) -> str:
    """Where ranges of equal numbers of rows begin, at or below `high`: at most one row per range."""
    column = quoted(key)
    numbered = (
        f"select {column} as place, ntile({ranges}) over (order by {column}) as piece "
        f"from {database.qualified(table)} where {column} <= {written(high, database.dialect)}"
    )
    return f"select piece, min(place) as place from ({numbered}) numbered group by piece"


def range_predicates(key: str, high, starts: Sequence, dialect: str) -> list[str]:
    """Conditions of which each row at or below `high`, or without a key, meets exactly one, and no other row meets any.

    `starts` are the first keys of the ranges in ascending order. A key may begin several ranges; they become one then.
    """
    column = quoted(key)
    if high is None:
        return [f"{column} is null"]
    top = f"{column} <= {written(high, dialect)}"
    cuts = [written(s, dialect) for s in dict.fromkeys(starts)]
    if len(cuts) < 2:
        return [f"({top} or {column} is null)"]
    first = f"({column} < {cuts[1]} or {column} is null)"
    between = [f"{column} >= {a} and {column} < {b}" for a, b in zip(cuts[1:], cuts[2:])]
    return [first, *between, f"{column} >= {cuts[-1]} and {top}"]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def written(value, dialect: str) -> str:
    """A key as a literal of the database."""
    if isinstance(value, dt.datetime):
        return f"cast('{value.isoformat(sep=' ')}' as {'datetime2' if dialect == 'sqlserver' else 'timestamp'})"
    if isinstance(value, dt.date):
        return f"cast('{value.isoformat()}' as date)"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (int, decimal.Decimal)) and not isinstance(value, bool):
        return f"{value:f}" if isinstance(value, decimal.Decimal) else str(value)
    raise ValueError(f"a cut needs a key of whole or decimal numbers, text, dates or times, not {value!r}")


def load_table(
    store: TableStore,
    namespace: str,
    table: str,
    source: DataFrame,
    version: str,
    incremental: Incremental | None = None,
    full_refresh: bool = False,
) -> dict:
    """Land one table and publish it; returns what moved and the cursor reached.

    Without `incremental`, or on a full refresh, the landing copy is replaced (this is also the
    only way deletions in the source get through). Otherwise rows at or past the newest landed
    cursor are read and merged, so a repeated load changes nothing.

    With a look-back window the result also tells the rows that landed behind the cursor (`late`) and, if asked for, those
    behind the window that did not land (`missed`). What was read inside the window is kept as a table of its own, published
    together with the landed one. An older version of a row that the first load dropped may be read once more.
    """
    landed = None if full_refresh or incremental is None else store.current(namespace, table)
    if landed is None:
        rows, keys, cursor = source, (), None
        if incremental is not None:
            keys, cursor = incremental.primary_key, incremental.cursor
            rows = latest_versions(past_cursor(source, cursor, incremental.initial_value), keys, cursor)
        staged = store.stage(namespace, table, rows, version, keys, cursor)
        done = {"table": table, "mode": "replace", "extracted": staged.rows, "high": staged.high}
        if incremental is None or incremental.look_back is None:
            store.publish([staged])
            return done
        # Taken from what landed, not from a second read of the source, so that no row is remembered that did not land.
        recent = past_cursor(store.read_version(staged), cursor, _window_start(staged, incremental))
        store.publish([staged, _seen_version(store, staged, recent, version)])
        return {**done, "late": 0, **({"missed": 0} if incremental.count_missed else {})}
    last = incremental.initial_value
    if landed.high is not None:
        last = F.lit(landed.high).cast(landed.struct[incremental.cursor].dataType)
    if incremental.look_back is None or landed.high is None:
        merged = store.merge(landed, past_cursor(source, incremental.cursor, last), version)
        return {"table": table, "mode": "merge", "extracted": merged.merged, "high": merged.high}
    return _load_window(store, landed, source, version, incremental, last)


def _window_start(landed: Version, rule: Incremental):
    """The newest landed cursor less the window, but not before the initial value; None where nothing has landed."""
    if landed.high is None:
        return rule.initial_value
    start = F.lit(landed.high).cast(landed.struct[rule.cursor].dataType) - F.lit(rule.look_back)
    return start if rule.initial_value is None else F.greatest(start, F.lit(rule.initial_value))


def _seen_table(table: str) -> str:
    return f"{table}__seen"


def _seen_version(store: TableStore, landed: Version, rows: DataFrame, version: str) -> Version:
    marks = with_digest(rows) if DIGEST not in rows.columns else rows
    return store.stage(landed.namespace, _seen_table(landed.table), marks.select(*landed.keys, landed.cursor, DIGEST).distinct(), version)


def _load_window(store: TableStore, landed: Version, source: DataFrame, version: str, rule: Incremental, last: Column) -> dict:
    keys, cursor, start = rule.primary_key, rule.cursor, _window_start(landed, rule)
    # Stored, so that what is landed and what is remembered come from one read of the source.
    window = cut_lineage(with_digest(past_cursor(source, cursor, start)), "window")
    fresh = window
    if store.current(landed.namespace, _seen_table(landed.table)) is not None:
        fresh = not_seen(window, store.read(landed.namespace, _seen_table(landed.table)), keys, cursor)
    late = fresh.where(F.col(cursor) < last).count()
    merged = store.merge(landed, fresh.drop(DIGEST), version, along=[_seen_version(store, landed, window, version)])
    done = {"table": landed.table, "mode": "merge", "extracted": merged.merged, "high": merged.high, "late": late}
    if rule.count_missed:
        older = source if rule.initial_value is None else source.where(F.col(cursor) >= F.lit(rule.initial_value))
        done["missed"] = missed_rows(older, store.read_version(merged), keys, cursor, start).count()
    return done
