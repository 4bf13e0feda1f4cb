"""Join helpers.

Keys are compared null-safely: a NULL key is a group like any other, as
``GROUP BY`` makes it.  Only the result of a literal top-k is hinted for
broadcast, as it has k rows by construction; the fine schedule is an inline
table whose size the planner knows.  Every other join is left to Catalyst's
size estimate and to adaptive execution, which re-checks the choice against
the real sizes and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal keys, NULL equal to NULL; the
    keys appear once, as the left side's."""
    cols = [on] if isinstance(on, str) else list(on)
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in cols})
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in cols])
    return left.join(other, match, how).drop(*[f"_right_{c}" for c in cols])


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str], top: bool = False) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys`` (left semi join); ``top`` says
    that ``keys`` is the result of a top-k."""
    cols = [on] if isinstance(on, str) else list(on)
    wanted = keys.select(*cols)
    return null_safe_join(df, F.broadcast(wanted) if top else wanted, cols, "left_semi")
