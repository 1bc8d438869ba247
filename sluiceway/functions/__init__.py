"""Column helpers: everything here is a built-in expression, so it stays inside code generation."""

from sluiceway.functions.conditions import in_set, is_live, is_strictly_true, not_blank, not_in_set, range_label
from sluiceway.functions.dates import due_at, month_key, wall_clock
from sluiceway.functions.keys import NULL_KEY_TOKEN, surrogate_key
from sluiceway.functions.numbers import duration, integral_text, money, percentage, with_rate
from sluiceway.functions.ordering import asc, desc
from sluiceway.functions.text import blank_to_null, clean, joined, lower_clean, reason, starts_with, upper_clean

__all__ = [
    "NULL_KEY_TOKEN", "asc", "blank_to_null", "clean", "desc", "due_at", "duration", "in_set", "integral_text",
    "is_live", "is_strictly_true", "joined", "lower_clean", "money", "month_key", "not_blank", "not_in_set",
    "percentage", "range_label", "reason", "starts_with", "surrogate_key", "upper_clean", "wall_clock", "with_rate",
]
