"""String helpers. `trim` removes spaces only, as SQL does; tabs and no-break spaces stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Empty text becomes NULL; nothing is trimmed."""
    return F.nullif(_col(c), F.lit(""))


def clean(c: Column | str) -> Column:
    """Text form, trimmed; what is then empty becomes NULL."""
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def lower_clean(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c).cast("string")))


def upper_clean(c: Column | str) -> Column:
    return F.upper(F.trim(_col(c).cast("string")))


def joined(*parts: Column) -> Column:
    """SQL `||`: NULL if any part is NULL."""
    return F.concat(*parts)


def starts_with(c: Column | str, prefix: str) -> Column:
    return _col(c).startswith(prefix)


def reason(template: str, *values: Column | str) -> Column:
    """A sentence built from row values; each `%s` takes one value, and NULL shows as empty text."""
    shown = [F.coalesce(_col(v).cast("string"), F.lit("")) for v in values]
    return F.format_string(template, *shown)
