"""Calendar predicates and parts.

``year_range`` is the half-open form ``lo <= d < hi`` with literals of the
column's own type.  Unlike ``year(d) = y`` it reaches the Parquet scan as
``GreaterThanOrEqual``/``LessThan`` pushed filters, so row groups and files
outside the year are skipped instead of read and discarded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _date_type(df: DataFrame, col: str) -> T.DataType:
    dtype = df.schema[col].dataType
    if not isinstance(dtype, _DATE_TYPES):
        raise TypeError(
            f"column {col!r} is {dtype.simpleString()}, not a date or timestamp; "
            "declare it in the read schema (see sources.records.read_records)"
        )
    return dtype


def year_range(df: DataFrame, col: str, year: int) -> Column:
    """Predicate selecting one calendar year of ``df[col]``."""
    dtype = _date_type(df, col)
    lo = F.lit(f"{year:04d}-01-01").cast(dtype)
    hi = F.lit(f"{year + 1:04d}-01-01").cast(dtype)
    return (F.col(col) >= lo) & (F.col(col) < hi)


def calendar_parts(
    df: DataFrame,
    date_col: str,
    year_col: str = "Issue_Year",
    month_col: str = "Issue_Month",
) -> DataFrame:
    """Add integer year and month columns taken from ``date_col``."""
    _date_type(df, date_col)
    return df.withColumns({year_col: F.year(date_col), month_col: F.month(date_col)})
