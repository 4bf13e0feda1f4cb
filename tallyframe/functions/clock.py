"""Twelve-hour clock text such as ``0143A`` / ``0400P`` / ``1223P``.

Text layout: two hour digits, two minute digits, then ``A`` or ``P``.
Everything is built from ``substring``, ``try_cast`` and ``CASE``, so it
runs in generated code with no Python.  ``try_cast`` turns text that is not
a number (``nan``, ``2A``) into NULL instead of failing under ANSI mode.

Midnight modes:

* ``"reference"`` (default) keeps the analysis' rule: add 12 for ``P``
  unless the hour is 12.  ``12xxA`` therefore stays hour 12.
* ``"strict"`` also maps ``12xxA`` to hour 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIDNIGHT_MODES = ("reference", "strict")


def _as_col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hour_text(col: str | Column) -> Column:
    """Characters 1-2: the hour as written (string)."""
    return F.substring(_as_col(col), 1, 2)


def meridiem(col: str | Column) -> Column:
    """Character 5: ``A`` or ``P`` (empty for short text)."""
    return F.substring(_as_col(col), 5, 1)


def hour24(col: str | Column, midnight: str = "reference") -> Column:
    """Hour on a 24-hour clock (int), NULL when the hour is not a number."""
    if midnight not in MIDNIGHT_MODES:
        raise ValueError(f"midnight must be one of {MIDNIGHT_MODES}, got {midnight!r}")
    hr = hour_text(col).try_cast("int")
    ampm = meridiem(col)
    pm = F.when((hr != F.lit(12)) & (ampm == F.lit("P")), hr + F.lit(12))
    if midnight == "strict":
        pm = pm.when((hr == F.lit(12)) & (ampm == F.lit("A")), F.lit(0))
    return pm.otherwise(hr)


def clock_parts(
    col: str | Column,
    midnight: str = "reference",
    hour_col: str = "Violation_hr",
    ampm_col: str = "Violation_AMPM",
    bin_col: str = "Violation_bin",
) -> dict[str, Column]:
    """The three derived clock columns, ready for ``withColumns``."""
    return {hour_col: hour_text(col), ampm_col: meridiem(col), bin_col: hour24(col, midnight)}
