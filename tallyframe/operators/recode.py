"""Repair of placeholder values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.filters import literal_like


def mode_of(df: DataFrame, col: str, exclude: Sequence[object] = ()) -> DataFrame:
    """One row: the most frequent non-NULL value of ``col`` not in ``exclude``.

    Ties go to the smallest value.  Counting is a partial + final aggregate;
    only the per-value counts reach the top-1 step.
    """
    kept = df.filter(F.col(col).isNotNull())
    for value in exclude:
        kept = kept.filter(F.col(col) != literal_like(df, col, value))
    counts = kept.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.col("_n").desc(), F.col(col).asc()).limit(1).select(col)


def recode_sentinel(
    df: DataFrame,
    col: str,
    sentinel: object,
    replacement: object = "mode",
) -> DataFrame:
    """Replace ``sentinel`` in ``col``; other values and NULLs are kept.

    ``replacement="mode"`` uses the most frequent real value (``mode_of``
    with the sentinel excluded).  The mode enters the plan as a scalar
    subquery: one value computed once and read by every task, with no join
    against the facts.  Any other replacement is used as a literal.
    """
    target = literal_like(df, col, sentinel)
    if isinstance(replacement, str) and replacement == "mode":
        value = mode_of(df, col, exclude=[sentinel]).scalar()
    else:
        value = literal_like(df, col, replacement)
    return df.withColumn(col, F.when(F.col(col) == target, value).otherwise(F.col(col)))


def mode_from_counts(
    counts: DataFrame, col: str, count_col: str, exclude: Sequence[object] = ()
) -> DataFrame:
    """``mode_of`` computed from a per-value count table instead of the facts.

    One aggregate without a filter: the smallest (-count, value) of the values
    that qualify.  So it starts from the very plan that makes ``counts``, and
    shares its exchange with whatever else reads ``counts``.
    """
    fits = F.col(col).isNotNull()
    for value in exclude:
        fits = fits & (F.col(col) != literal_like(counts, col, value))
    rank = F.struct((-F.col(count_col)).alias("rank"), F.col(col).alias("value"))
    return counts.agg(F.min(F.when(fits, rank)).alias("first")).select(F.col("first.value").alias(col))


def recode_counts(
    counts: DataFrame,
    col: str,
    count_cols: Sequence[str],
    sentinel: object,
    replacement: object = "mode",
    mode_count_col: str | None = None,
    counts_of_col: bool = True,
) -> DataFrame:
    """Per-value counts *after* ``recode_sentinel``, from the counts before it.

    Counting then re-keying equals re-keying then counting: the sentinel's
    row is relabelled and merged into its replacement's.  The facts are
    read once, by whatever produced ``counts``.  ``counts_of_col`` says the
    counts are ``COUNT(col)``: a row re-keyed to NULL (no mode exists) then
    counts 0, as the NULL group does.  Use ``False`` for ``COUNT(*)``.
    """
    target = literal_like(counts, col, sentinel)
    if isinstance(replacement, str) and replacement == "mode":
        value = mode_from_counts(counts, col, mode_count_col or count_cols[0], [sentinel]).scalar()
    else:
        value = literal_like(counts, col, replacement)
    rekeyed = counts.withColumn(col, F.when(F.col(col) == target, value).otherwise(F.col(col)))
    if counts_of_col:
        rekeyed = rekeyed.withColumns(
            {c: F.when(F.col(col).isNull(), F.lit(0)).otherwise(F.col(c)) for c in count_cols}
        )
    return rekeyed.groupBy(col).agg(*[F.sum(c).alias(c) for c in count_cols])
