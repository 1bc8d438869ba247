"""Verified bronze batches: snapshots of source tables as hashed files, loaded all or nothing."""

from sluiceway.bronze.batch import BronzeError, extract, load, verify
from sluiceway.bronze.types import stored_columns, stored_type, typed_columns

__all__ = ["BronzeError", "extract", "load", "stored_columns", "stored_type", "typed_columns", "verify"]
