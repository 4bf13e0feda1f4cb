"""DataFrame -> DataFrame operators (built-in functions; only the summary of ``heavy`` runs in Python, by Arrow batches)."""

from tallyframe.operators.counts import (
    count_of,
    crosstab_counts,
    distinct_count,
    row_count,
    value_counts,
)
from tallyframe.operators.distinct_store import stored_distinct, value_bitmaps, value_numbers
from tallyframe.operators.filters import (
    drop_sentinel,
    in_year,
    not_null_rows,
    null_count,
    null_rows,
    only_value,
    profile_nulls,
)
from tallyframe.operators.fines import (
    RATE_A,
    RATE_B,
    fine_totals,
    rate_schedule,
    revenue,
    schedule_means,
)
from tallyframe.operators.heavy import heavy_top_k
from tallyframe.operators.intervals import in_intervals
from tallyframe.operators.joins import keep_keys, null_safe_join
from tallyframe.operators.lift import exceptional_shares, share_lift, spread
from tallyframe.operators.recode import mode_from_counts, mode_of, recode_counts, recode_sentinel
from tallyframe.operators.topk import (
    counted_top_k_per_group,
    rows_of_top_groups,
    top_groups,
    top_k,
    top_k_per_group,
)

__all__ = [
    "mode_from_counts",
    "recode_counts",
    "rows_of_top_groups",
    "top_groups",
    "RATE_A",
    "RATE_B",
    "count_of",
    "counted_top_k_per_group",
    "crosstab_counts",
    "distinct_count",
    "drop_sentinel",
    "exceptional_shares",
    "fine_totals",
    "heavy_top_k",
    "in_intervals",
    "in_year",
    "keep_keys",
    "mode_of",
    "not_null_rows",
    "null_safe_join",
    "null_count",
    "null_rows",
    "only_value",
    "profile_nulls",
    "rate_schedule",
    "recode_sentinel",
    "revenue",
    "row_count",
    "schedule_means",
    "share_lift",
    "spread",
    "top_k",
    "stored_distinct",
    "top_k_per_group",
    "value_bitmaps",
    "value_counts",
    "value_numbers",
]
