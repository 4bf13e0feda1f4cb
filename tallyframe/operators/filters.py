"""Row filters: calendar slice, sentinels, NULL profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.calendar import year_range


def literal_like(df: DataFrame, col: str, value: object) -> Column:
    """``value`` as a literal comparable with ``df[col]`` without implicit casts.

    A string column compared with the number 99 would raise under ANSI
    mode, so numbers are written as text for string columns.
    """
    if isinstance(df.schema[col].dataType, T.StringType) and not isinstance(value, str):
        return F.lit(str(value))
    return F.lit(value)


def in_year(df: DataFrame, date_col: str, year: int) -> DataFrame:
    """Rows of one calendar year; the range reaches the scan as pushed filters."""
    return df.filter(year_range(df, date_col, year))


def drop_sentinel(df: DataFrame, col: str, sentinel: object) -> DataFrame:
    """``WHERE col <> sentinel``: drops the sentinel and NULL rows alike."""
    return df.filter(F.col(col) != literal_like(df, col, sentinel))


def only_value(df: DataFrame, col: str, value: object) -> DataFrame:
    """``WHERE col = value`` (pushed to the scan for plain columns)."""
    return df.filter(F.col(col) == literal_like(df, col, value))


def null_rows(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def not_null_rows(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def profile_nulls(df: DataFrame, cols: Sequence[str], prefix: str = "n_null_") -> DataFrame:
    """One row with the NULL count of each column, in a single pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{prefix}{c}") for c in cols])


def null_count(df: DataFrame, col: str, name: str = "n_null") -> DataFrame:
    """One row: how many rows have ``col`` NULL."""
    return df.agg(F.count_if(F.col(col).isNull()).alias(name))
