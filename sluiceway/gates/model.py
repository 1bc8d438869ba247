"""What a gate is, and what it found."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AGE = re.compile(r"(\d+)([smhd])")
_AGE_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}

# The type names a contract may use, and the Spark type each one means.
TYPE_NAMES = {
    "smallint": "smallint", "int2": "smallint",
    "int": "int", "int4": "int", "integer": "int",
    "int8": "bigint", "bigint": "bigint", "long": "bigint",
    "bool": "boolean", "boolean": "boolean",
    "text": "string", "varchar": "string", "character varying": "string", "string": "string",
    "numeric": "decimal", "decimal": "decimal",
    "real": "float", "float": "float", "double": "double", "double precision": "double",
    "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
    "date": "date",
}


class GateError(ValueError):
    """A gate is declared wrongly."""


def type_name(kind: T.DataType) -> str:
    """A Spark type as contracts name it: a decimal is a decimal, whatever its precision."""
    return "decimal" if isinstance(kind, T.DecimalType) else kind.simpleString()


def contract_type(name: str) -> str:
    plain = name.strip().lower()
    return TYPE_NAMES.get(plain, plain)


def _names(value, what: str) -> tuple[str, ...]:
    if isinstance(value, str) or not value or not all(isinstance(v, str) for v in value):
        raise GateError(f"{what} must be a non-empty list of column names, got {value!r}")
    return tuple(value)


@dataclass(frozen=True)
class SchemaContract:
    """Each declared column exists with the declared type; other columns are allowed."""

    tables: Mapping[str, Mapping[str, str]]
    kind = "schema_contract"

    def __post_init__(self):
        ok = isinstance(self.tables, Mapping) and self.tables and all(
            isinstance(cols, Mapping) and cols and all(isinstance(t, str) for t in cols.values())
            for cols in self.tables.values()
        )
        if not ok:
            raise GateError(f"schema_contract: tables must map each table to its columns and types, got {self.tables!r}")

    def mismatches(self, tables: Mapping[str, DataFrame]) -> dict[str, dict]:
        found = {}
        for table, columns in self.tables.items():
            actual = {f.name: type_name(f.dataType) for f in tables[table].schema.fields}
            wrong = {c: (contract_type(t), actual.get(c)) for c, t in columns.items() if contract_type(t) != actual.get(c)}
            if wrong:
                found[table] = wrong
        return found


@dataclass(frozen=True)
class Freshness:
    """The newest moment is at most `max_age` old ('30m', '24h', '7d'). An empty table passes."""

    tables: Sequence[str]
    column: str
    max_age: str
    kind = "freshness"

    def __post_init__(self):
        _names(self.tables, "freshness: tables")
        if not _AGE.fullmatch(str(self.max_age)):
            raise GateError(f"freshness: max_age {self.max_age!r} must be a number and one of s, m, h, d")

    def newest(self, df: DataFrame, counted: Column | None = None) -> Column:
        """The newest moment of the rows that count, as wall-clock time in the session zone (UTC)."""
        kind = df.schema[self.column].dataType
        if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise GateError(f"freshness: {self.column} is {kind.simpleString()}, not a date or timestamp")
        moment = F.col(self.column) if counted is None else F.when(counted, F.col(self.column))
        return F.max(moment).cast("timestamp_ntz")

    @property
    def age(self) -> dt.timedelta:
        number, unit = _AGE.fullmatch(self.max_age).groups()
        return dt.timedelta(**{_AGE_UNITS[unit]: int(number)})


@dataclass(frozen=True)
class RowCountBounds:
    """The row count lies within bounds, and near the last finished run's count."""

    table: str
    min: int | None = None
    max: int | None = None
    max_delta_pct: float | None = None
    kind = "row_count_bounds"

    def verdict(self, n: int, previous: int | None) -> str | None:
        """None if `n` is fine, else what is wrong. No previous count, or zero, skips the comparison."""
        if self.min is not None and n < self.min:
            return f"row count {n} is below min {self.min}"
        if self.max is not None and n > self.max:
            return f"row count {n} is above max {self.max}"
        if self.max_delta_pct is not None and previous:
            change = abs(n - previous) / previous * 100
            if change > self.max_delta_pct:
                return f"row count {n} is {change:.0f}% off the previous {previous} (allowed {self.max_delta_pct}%)"
        return None


@dataclass(frozen=True)
class NotNull:
    table: str
    columns: Sequence[str]
    kind = "not_null"

    def __post_init__(self):
        object.__setattr__(self, "columns", _names(self.columns, "not_null: columns"))

    @property
    def reason(self) -> str:
        return f"not_null: one of {', '.join(self.columns)} is null"

    def rejects(self) -> Column:
        out = F.col(self.columns[0]).isNull()
        for c in self.columns[1:]:
            out = out | F.col(c).isNull()
        return out


@dataclass(frozen=True)
class Unique:
    """Every copy of a repeated key is rejected, the first included; a key holding a NULL never repeats."""

    table: str
    columns: Sequence[str]
    kind = "unique"

    def __post_init__(self):
        object.__setattr__(self, "columns", _names(self.columns, "unique: columns"))

    @property
    def reason(self) -> str:
        return f"unique: duplicate {', '.join(self.columns)}"

    def repeated_keys(self, df: DataFrame) -> DataFrame:
        """Keys to reject, without any that holds a NULL."""
        return df.dropna(subset=list(self.columns)).groupBy(*self.columns).agg(
            F.count(F.lit(1)).alias("n")
        ).where("n > 1")

    def report(self, df: DataFrame) -> DataFrame:
        """Repeated keys with their counts. Unlike the rejection, the report groups NULL keys too."""
        return df.groupBy(*self.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@dataclass(frozen=True)
class ReferentialIntegrity:
    """A non-NULL foreign key has a parent."""

    table: str
    column: str
    references: Mapping[str, str]
    kind = "referential_integrity"

    def __post_init__(self):
        if set(self.references) != {"table", "column"}:
            raise GateError("referential_integrity: references must name a table and a column")

    @property
    def reason(self) -> str:
        return f"referential_integrity: {self.column} not found in {self.references['table']}.{self.references['column']}"

    def orphan_keys(self, df: DataFrame, parent: DataFrame) -> DataFrame:
        keys = df.select(self.column).where(F.col(self.column).isNotNull()).distinct()
        parents = parent.select(F.col(self.references["column"]).alias("_parent"))
        return keys.join(parents, F.col(self.column) == F.col("_parent"), "left_anti")


@dataclass(frozen=True)
class BusinessRule:
    """SQL over the stage's tables that returns the ids of offending rows."""

    name: str
    sql: str
    table: str
    id_column: str
    expect: str = "no_rows"
    kind = "business_rule"

    def __post_init__(self):
        if self.expect != "no_rows":
            raise GateError(f"business_rule: expect {self.expect!r} must be 'no_rows'")

    @property
    def reason(self) -> str:
        return f"business_rule: {self.name}"


Gate = SchemaContract | Freshness | RowCountBounds | NotNull | Unique | ReferentialIntegrity | BusinessRule
ROW_GATES = (NotNull, Unique, ReferentialIntegrity, BusinessRule)
_BY_KIND = {g.kind: g for g in (SchemaContract, Freshness, RowCountBounds, *ROW_GATES)}


def gate_from_dict(raw: Mapping) -> Gate:
    """A gate from a `{type, ...}` mapping. Unknown parameters are refused: one that is ignored
    (`min_rows` for `min`) would make the gate pass without checking anything."""
    kind = raw.get("type")
    cls = _BY_KIND.get(kind)
    if cls is None:
        raise GateError(f"unknown gate type {kind!r}; expected one of {sorted(_BY_KIND)}")
    params = {k: v for k, v in raw.items() if k != "type"}
    known = {f.name: f for f in fields(cls)}
    missing = [n for n, f in known.items() if f.default is MISSING and n not in params]
    if cls is BusinessRule and "expect" not in params:
        missing.append("expect")
    if missing:
        raise GateError(f"{kind}: missing {sorted(missing)}")
    unknown = sorted(set(params) - set(known))
    if unknown:
        raise GateError(f"{kind}: unknown parameter(s) {unknown}; this gate knows {sorted(known)}")
    return cls(**params)


@dataclass(frozen=True)
class Quarantine:
    """Rejected rows are moved aside; a gate fails when it rejects more than this percentage."""

    reject_threshold_pct: float

    def __post_init__(self):
        if not 0 <= float(self.reject_threshold_pct) <= 100:
            raise GateError(f"reject_threshold_pct {self.reject_threshold_pct!r} must be 0-100")


@dataclass(frozen=True)
class GateResult:
    gate_type: str
    status: str
    table: str | None = None
    rows_checked: int | None = None
    rows_rejected: int | None = None
    detail: str = ""

    @property
    def passed(self) -> bool:
        return self.status == "passed"


@dataclass
class StageOutcome:
    """Gate results in order, the tables without rejected rows and where those were written, the rejected
    rows per table, and the rows left in each table that a gate names."""

    results: list[GateResult]
    tables: dict[str, DataFrame]
    rejected: dict[str, DataFrame] = field(default_factory=dict)
    row_counts: dict[str, int] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    @property
    def failures(self) -> list[str]:
        return [f"{r.gate_type}: {r.detail}" for r in self.results if not r.passed]


def row_verdict(gate: Gate, rejected: int, total: int, quarantine: Quarantine | None) -> GateResult:
    """Pass or fail of a row gate from its counts. The threshold is exceeded only above it, not at it."""
    def result(status: str, detail: str) -> GateResult:
        return GateResult(gate.kind, status, gate.table, total, rejected, detail)

    if rejected == 0:
        return result("passed", "")
    where = f"{rejected}/{total} row(s) in {gate.table}"
    if quarantine is None:
        return result("failed", f"{where} failed {gate.kind}, no quarantine declared")
    share = 100.0 if total == 0 else rejected / total * 100
    if share > quarantine.reject_threshold_pct:
        return result(
            "failed",
            f"{where} ({share:.1f}%) quarantined for {gate.kind}, above the {quarantine.reject_threshold_pct}% threshold",
        )
    return result("passed", f"{where} quarantined for {gate.kind}")


def crashed(gate: Gate, exc: Exception) -> GateResult:
    return GateResult(
        gate.kind, "failed", getattr(gate, "table", None),
        detail=f"the gate itself raised {type(exc).__name__}: {exc}",
    )


def schema_verdict(gate: SchemaContract, tables: Mapping[str, DataFrame]) -> GateResult:
    wrong = gate.mismatches(tables)
    return GateResult(gate.kind, "failed" if wrong else "passed", detail=str(wrong) if wrong else "")


def freshness_verdict(gate: Freshness, newest: Mapping[str, dt.datetime | None], now: dt.datetime) -> GateResult:
    stale = [t for t in gate.tables if newest[t] is not None and newest[t] < now - gate.age]
    detail = f"{', '.join(stale)} older than {gate.max_age}" if stale else ""
    return GateResult(gate.kind, "failed" if stale else "passed", detail=detail)


def count_verdict(gate: RowCountBounds, n: int, previous: int | None) -> GateResult:
    wrong = gate.verdict(n, previous)
    return GateResult(gate.kind, "failed" if wrong else "passed", gate.table, n, None, wrong or "")


def rejected_with_reason(rows: DataFrame, reason: Column, run_id: int | None) -> DataFrame:
    """Quarantine shape: the table's own columns, then the reason and the run."""
    return rows.withColumns({"reason": reason, "run_id": F.lit(run_id).cast("bigint")})
