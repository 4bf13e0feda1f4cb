"""Label a column by the first matching bucket.

Both builders compile to one ``CASE WHEN`` expression that stays inside
whole-stage code generation; the first matching bucket wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference analysis.
# Six four-hour bins of the 24-hour clock, closed at both ends; every other
# value, NULL included, is labelled "Night".
TIME_OF_DAY_BINS: tuple[tuple[str, int, int], ...] = (
    ("Late_Night", 0, 3),
    ("Early_Morning", 4, 7),
    ("Morning", 8, 11),
    ("Afternoon", 12, 15),
    ("Evening", 16, 19),
)
TIME_OF_DAY_DEFAULT = "Night"
# Seasons by month of issue.  Winter is 1, 12 and 11 of the same calendar
# year; months outside 1..12 (or NULL) get no season.
SEASONS: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("Winter", (1, 12, 11)),
    ("Spring", (2, 3, 4)),
    ("Summer", (5, 6, 7)),
    ("Fall", (8, 9, 10)),
)


def _as_col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bucket_intervals(
    col: str | Column,
    spec: Sequence[tuple[str, int, int]] = TIME_OF_DAY_BINS,
    default: str | None = TIME_OF_DAY_DEFAULT,
) -> Column:
    """Label by closed intervals ``lo <= x <= hi``; ``default`` otherwise."""
    c = _as_col(col)
    if not spec:
        raise ValueError("spec must hold at least one bucket")
    expr = None
    for label, lo, hi in spec:
        if lo > hi:
            raise ValueError(f"bucket {label!r}: {lo} > {hi}")
        cond = (c >= F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def bucket_members(
    col: str | Column,
    spec: Iterable[tuple[str, Sequence[object]]] = SEASONS,
    default: str | None = None,
) -> Column:
    """Label by membership lists; ``default`` (NULL unless given) otherwise."""
    c = _as_col(col)
    expr = None
    for label, members in spec:
        cond = c.isin(list(members))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        raise ValueError("spec must hold at least one bucket")
    return expr.otherwise(F.lit(default)) if default is not None else expr
