"""Date and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(c: Column | str) -> Column:
    """'YYYY-MM'."""
    return F.date_format(_col(c), "yyyy-MM")


def wall_clock(c: Column | str) -> Column:
    """An instant as wall-clock time in the session zone."""
    return _col(c).cast("timestamp_ntz")


def due_at(promised: Column | str, placed: Column | str, hours: int) -> Column:
    """The promised time, or `hours` after the order when none was promised."""
    return F.coalesce(_col(promised), _col(placed) + F.make_dt_interval(hours=F.lit(hours)))
