"""Column-level helpers (built-in expressions only, no UDFs)."""

from tallyframe.functions.buckets import (
    SEASONS,
    TIME_OF_DAY_BINS,
    TIME_OF_DAY_DEFAULT,
    bucket_intervals,
    bucket_members,
)
from tallyframe.functions.calendar import calendar_parts, year_range
from tallyframe.functions.clock import clock_parts, hour24, hour_text, meridiem

__all__ = [
    "SEASONS",
    "TIME_OF_DAY_BINS",
    "TIME_OF_DAY_DEFAULT",
    "bucket_intervals",
    "bucket_members",
    "calendar_parts",
    "clock_parts",
    "hour24",
    "hour_text",
    "meridiem",
    "year_range",
]
