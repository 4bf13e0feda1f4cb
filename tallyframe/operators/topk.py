"""Deterministic top-k, overall and per group.

``top_k`` is ``ORDER BY measure DESC, keys ASC LIMIT k``: Spark runs it as
``TakeOrderedAndProject`` (k rows kept per task, then merged), never a full
sort.  The key tie-break makes the cut independent of partitioning.

``top_k_per_group`` ranks *aggregated* rows with a window and filters on the
rank directly, so the optimizer inserts ``WindowGroupLimit`` both before the
exchange (each task keeps its top k per group) and after it.  A group that
holds a third of all facts therefore reaches one task as at most
k rows (plus ties) per upstream task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.counts import as_list, by_measure, count_of
from tallyframe.operators.filters import literal_like
from tallyframe.operators.joins import null_safe_join

TIES = ("dense", "rank", "row")


def top_k(df: DataFrame, measure: str, keys: str | Sequence[str], k: int) -> DataFrame:
    """The k rows with the largest ``measure``; ties broken by ``keys``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return df.orderBy(*by_measure(measure, as_list(keys))).limit(k)


def top_k_per_group(
    counts: DataFrame,
    group: str | Sequence[str],
    item: str | Sequence[str],
    measure: str,
    k: int,
    ties: str = "dense",
    rank_col: str | None = None,
    order: bool = True,
) -> DataFrame:
    """Top-k ``item`` rows per ``group`` by ``measure``.

    ``ties="dense"`` keeps every row whose ``dense_rank`` is at most k (ties
    kept, so a group may return more than k rows); ``"rank"`` uses ``rank``;
    ``"row"`` uses ``row_number`` with ``item`` as tie-break and returns at
    most k rows per group.
    """
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}, got {ties!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    groups, items = as_list(group), as_list(item)
    rk = rank_col or "_rk"
    if ties == "row":
        w = Window.partitionBy(*groups).orderBy(*by_measure(measure, items))
        rank = F.row_number().over(w)
    else:
        w = Window.partitionBy(*groups).orderBy(F.col(measure).desc_nulls_last())
        rank = (F.dense_rank() if ties == "dense" else F.rank()).over(w)
    out = counts.withColumn(rk, rank).filter(F.col(rk) <= F.lit(k))
    if rank_col is None:
        out = out.drop(rk)
    if order:
        out = out.orderBy(*[F.col(g).asc_nulls_first() for g in groups], *by_measure(measure, items))
    return out


def counted_top_k_per_group(
    df: DataFrame,
    group: str | Sequence[str],
    item: str | Sequence[str],
    k: int,
    name: str = "n",
    ties: str = "dense",
    count_col: str | None = None,
    rank_col: str | None = None,
) -> DataFrame:
    """Count (group, item) pairs, then keep the top k items per group."""
    keys = as_list(group) + as_list(item)
    counts = df.groupBy(*keys).agg(count_of(count_col).alias(name))
    return top_k_per_group(counts, group, item, name, k, ties=ties, rank_col=rank_col)


def top_groups(
    pairs: DataFrame,
    group: str,
    measure: str,
    k: int,
    name: str,
    sentinel: object = None,
) -> DataFrame:
    """Top-k ``group`` values by the summed ``measure`` of an aggregated table.

    A NULL group counts like any other.  With ``sentinel``, the sentinel and
    NULL groups are left out (as ``WHERE group <> sentinel``).  They are ranked
    last and dropped after the cut: a filter before it would be pushed below
    the aggregate that makes ``pairs``, whose exchange the caller's other
    branches could then not share.
    """
    totals = pairs.groupBy(group).agg(F.sum(measure).alias(name))
    if sentinel is None:
        return top_k(totals, name, group, k)
    real = F.coalesce(F.col(group) != literal_like(totals, group, sentinel), F.lit(False))
    ranked = totals.orderBy(real.desc(), *by_measure(name, [group])).limit(k)
    return ranked.filter(real)


def rows_of_top_groups(
    pairs: DataFrame,
    group: str,
    measure: str,
    k: int,
    total_col: str,
    sentinel: object = None,
) -> DataFrame:
    """All rows of the k groups with the largest summed ``measure``.

    Group totals are an aggregate of ``pairs``, the top k of them a top-k, and
    its k rows are broadcast and joined back, whatever k is.  Both branches
    start from the same aggregated pairs, so the second one reuses the
    first one's exchange and the facts are read once; no task gathers a group,
    and no pairs are sorted.  Ties between totals go to the smaller key and a
    NULL group is a group, as in ``top_groups``.
    """
    top = top_groups(pairs, group, measure, k, total_col, sentinel)
    return null_safe_join(pairs, F.broadcast(top), group).select(*pairs.columns, total_col)
