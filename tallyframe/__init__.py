"""tallyframe: frequency, top-k and bucketing analytics on Spark DataFrames.

Operators are plain ``DataFrame -> DataFrame`` functions built from
Spark's built-in expressions.  Only the summary of ``heavy_top_k`` runs in Python,
by Arrow batches; what it and ``value_numbers`` collect is bounded.  See ``README.md`` for the map from the reference
analysis to these functions.
"""

from tallyframe.functions import (
    SEASONS,
    TIME_OF_DAY_BINS,
    bucket_intervals,
    bucket_members,
    calendar_parts,
    clock_parts,
    hour24,
    year_range,
)
from tallyframe.operators import (
    crosstab_counts,
    distinct_count,
    drop_sentinel,
    fine_totals,
    heavy_top_k,
    in_year,
    mode_of,
    rate_schedule,
    recode_counts,
    recode_sentinel,
    revenue,
    row_count,
    rows_of_top_groups,
    share_lift,
    stored_distinct,
    top_groups,
    top_k,
    top_k_per_group,
    value_bitmaps,
    value_counts,
    value_numbers,
)
from tallyframe.plans.report import ticket_report
from tallyframe.sources import (
    StageFolder,
    TooManyRejects,
    normalize_columns,
    read_records,
    register_stage,
    reject_counts,
    take_in,
    text_records,
)
from tallyframe.sources.partials import PartTable, StoredCounts

__version__ = "0.1.0"

__all__ = [
    "SEASONS",
    "PartTable",
    "StageFolder",
    "StoredCounts",
    "TIME_OF_DAY_BINS",
    "TooManyRejects",
    "bucket_intervals",
    "bucket_members",
    "calendar_parts",
    "clock_parts",
    "crosstab_counts",
    "distinct_count",
    "drop_sentinel",
    "fine_totals",
    "heavy_top_k",
    "hour24",
    "in_year",
    "mode_of",
    "normalize_columns",
    "rate_schedule",
    "read_records",
    "recode_counts",
    "recode_sentinel",
    "register_stage",
    "reject_counts",
    "revenue",
    "row_count",
    "rows_of_top_groups",
    "share_lift",
    "stored_distinct",
    "take_in",
    "text_records",
    "ticket_report",
    "top_groups",
    "top_k",
    "top_k_per_group",
    "value_bitmaps",
    "value_counts",
    "value_numbers",
    "year_range",
]
