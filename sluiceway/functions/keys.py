"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text that stands for NULL inside a surrogate key, so NULL and '' differ.
NULL_KEY_TOKEN = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*parts: Column | str) -> Column:
    """md5 of the text forms of `parts` joined by '-'."""
    texts = [
        F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NULL_KEY_TOKEN)) for p in parts
    ]
    return F.md5(F.concat_ws("-", *texts))
