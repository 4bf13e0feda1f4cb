"""Exact frequencies and distinct counts.

Every count is a ``groupBy(...).agg(count)``: Spark plans it as a partial
aggregate in each map task, a hash exchange of one row per key per task,
then a final aggregate.  A key holding a third of all rows is therefore
combined map-side and never shipped row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import keep_keys


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def count_of(count_col: str | None = None) -> Column:
    """``COUNT(col)`` (non-NULL values) when a column is named, else ``COUNT(*)``.

    Grouped by the counted column itself, ``COUNT(col)`` reports the NULL
    group with a count of 0; ``COUNT(*)`` counts its rows.
    """
    return F.count(F.col(count_col)) if count_col else F.count(F.lit(1))


def by_measure(measure: str, keys: Sequence[str]) -> list[Column]:
    """Total order: measure descending (NULLs last), then keys ascending."""
    return [F.col(measure).desc_nulls_last()] + [F.col(k).asc_nulls_first() for k in keys]


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """One row: the number of rows of ``df``."""
    return df.agg(F.count(F.lit(1)).alias(name))


def distinct_count(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row: exact number of distinct non-NULL values of ``col``."""
    return df.agg(F.count_distinct(F.col(col)).alias(name))


def value_counts(
    df: DataFrame,
    keys: str | Sequence[str],
    name: str = "n",
    count_col: str | None = None,
    order: bool = True,
) -> DataFrame:
    """Rows per distinct key (absent keys are not zero-filled).

    ``order=True`` sorts by the count descending, ties by key; the sort is
    over the aggregated rows, never the facts.
    """
    ks = as_list(keys)
    out = df.groupBy(*ks).agg(count_of(count_col).alias(name))
    return out.orderBy(*by_measure(name, ks)) if order else out


def crosstab_counts(
    df: DataFrame,
    row_key: str,
    col_key: str,
    name: str = "n",
    only: DataFrame | None = None,
) -> DataFrame:
    """Counts per (row_key, col_key), sorted by row_key, col_key, count desc.

    ``only`` restricts ``row_key`` to the values it holds (a semi join) before
    counting.
    """
    src = df if only is None else keep_keys(df, only, row_key)
    out = src.groupBy(row_key, col_key).agg(count_of().alias(name))
    return out.orderBy(
        F.col(row_key).asc_nulls_first(), F.col(col_key).asc_nulls_first(), F.col(name).desc()
    )

