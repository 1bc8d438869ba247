"""Named metrics and charts over one dataset."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.compare import Comparison, compare_expected, same_rows

_METRIC = re.compile(r"\s*(COUNT|SUM|MIN|MAX|AVG)\s*\(\s*(DISTINCT\s+)?(\*|[A-Za-z_]\w*)\s*\)\s*", re.IGNORECASE)


class ChartError(ValueError):
    """A chart asks for something its dataset does not offer."""


@dataclass(frozen=True)
class DatasetColumn:
    name: str
    groupby: bool = True
    filterable: bool = True
    temporal: bool = False


@dataclass(frozen=True)
class Chart:
    """A grouped query. `row_limit` is the chart's own limit, and `order` decides which rows it keeps."""

    metrics: Sequence[str]
    columns: Sequence[str] = ()
    row_limit: int | None = None
    order: Sequence[Column] = ()


@dataclass(frozen=True)
class Dataset:
    columns: Sequence[DatasetColumn]
    metrics: Mapping[str, str]
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self._by_name.update({c.name: c for c in self.columns})
        for expression in self.metrics.values():
            self._parse(expression)

    def _parse(self, expression: str) -> tuple[str, bool, str]:
        """COUNT(*), COUNT(DISTINCT c), SUM(c), MIN(c), MAX(c) or AVG(c) over declared columns."""
        found = _METRIC.fullmatch(expression)
        if not found:
            raise ChartError(f"metric {expression!r} is not one of COUNT(*), COUNT(DISTINCT c), SUM(c), MIN(c), MAX(c), AVG(c)")
        name, distinct, column = found[1].lower(), bool(found[2]), found[3]
        if column == "*" and (name != "count" or distinct):
            raise ChartError(f"metric {expression!r}: only COUNT takes *")
        if column != "*" and column not in self._by_name:
            raise ChartError(f"metric {expression!r}: unknown column {column!r}")
        if distinct and name != "count":
            raise ChartError(f"metric {expression!r}: DISTINCT is for COUNT")
        return name, distinct, column

    def _metric(self, expression: str) -> Column:
        name, distinct, column = self._parse(expression)
        if column == "*":
            return F.count(F.lit(1))
        return F.count_distinct(F.col(column)) if distinct else getattr(F, name)(F.col(column))

    def _allowed(self, column: str, role: str) -> str:
        declared = self._by_name.get(column)
        if declared is None or not getattr(declared, role):
            raise ChartError(f"column {column!r} is not declared as {role}")
        return column

    def query(self, table: DataFrame, chart: Chart, filters: Mapping[str, Sequence] | None = None) -> DataFrame:
        """The chart's rows. Filters (column in values) apply to the rows before they are grouped."""
        rows = table
        for column, values in (filters or {}).items():
            rows = rows.where(F.col(self._allowed(column, "filterable")).isin(list(values)))
        unknown = [m for m in chart.metrics if m not in self.metrics]
        if unknown or not chart.metrics:
            raise ChartError(f"unknown metric(s) {unknown}" if unknown else "a chart needs at least one metric")
        measures = [self._metric(self.metrics[m]).alias(m) for m in chart.metrics]
        groups = [self._allowed(c, "groupby") for c in chart.columns]
        result = rows.groupBy(*groups).agg(*measures) if groups else rows.agg(*measures)
        if chart.row_limit is None:
            return result
        if not chart.order:
            raise ChartError("a row limit needs an order, or it would keep arbitrary rows")
        return result.orderBy(*chart.order).limit(chart.row_limit)

    def dashboard(
        self, table: DataFrame, charts: Mapping[str, Chart], filters: Mapping[str, Sequence] | None = None,
        scope: Mapping[str, Sequence[str]] | None = None,
    ) -> dict[str, DataFrame]:
        """All charts, each under the filters that have it in scope (all of them by default)."""
        def mine(chart: str) -> dict:
            return {c: v for c, v in (filters or {}).items() if scope is None or chart in scope.get(c, charts)}

        return {name: self.query(table, chart, mine(name)) for name, chart in charts.items()}


def check_chart(chart_rows: DataFrame, independent: DataFrame, expected: Sequence[Mapping]) -> Comparison:
    """A chart equals an independent query and the literal rows, as bags."""
    literal = compare_expected(chart_rows, expected, row_count=len(expected))
    if not literal.ok:
        return literal
    if not same_rows(chart_rows, independent.select(*chart_rows.columns)):
        return Comparison(False, "the chart differs from the independent query")
    return literal
