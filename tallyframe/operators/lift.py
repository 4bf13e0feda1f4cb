"""Is an item over-represented in a group, and is it shared across groups?"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import null_safe_join


def share_lift(
    pair_counts: DataFrame,
    group: str,
    item: str,
    measure: str,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Share of each item within its group over its share overall.

    ``pair_counts`` holds one row per (group, item) with a count.  Group and
    item totals are aggregates of it, the grand total is a scalar subquery;
    they are joined back by key, which Spark broadcasts or shuffle-joins by
    size.  ``groups``, a top-k of distinct groups, limits the output (not the totals) to some
    groups.  A NULL group or item is one like any other.
    """
    group_tot = pair_counts.groupBy(group).agg(F.sum(measure).alias("_group_total"))
    item_tot = pair_counts.groupBy(item).agg(F.sum(measure).alias("_item_total"))
    grand = pair_counts.agg(F.sum(measure).alias("_grand")).scalar()
    rows = pair_counts
    if groups is not None:
        # An inner join with the unique keys; a semi join would be pushed below the
        # aggregate that makes the pairs, which then could not be shared.
        rows = null_safe_join(pair_counts, F.broadcast(groups.select(group)), group)
    totals = null_safe_join(null_safe_join(rows, group_tot, group), item_tot, item)
    shares = totals.select(
        group,
        item,
        measure,
        (F.col(measure).cast("double") / F.col("_group_total").cast("double")).alias("share_in_group"),
        (F.col("_item_total").cast("double") / grand.cast("double")).alias("share_overall"),
    )
    # A second projection, so the scalar subquery is evaluated once per row.
    return shares.withColumn("lift", F.col("share_in_group") / F.col("share_overall"))

def spread(rows: DataFrame, item: str, group: str, name: str = "n_groups") -> DataFrame:
    """In how many distinct groups each item appears, most widespread first."""
    out = rows.groupBy(item).agg(F.count_distinct(F.col(group)).alias(name))
    return out.orderBy(F.col(name).desc(), F.col(item).asc_nulls_first())


# erfc(x) = t * exp(-x*x + polynomial of t), t = 1 / (1 + x/2), x >= 0, by Chebyshev fitting; relative error
# below 1.2e-7.  Fixed values, from the constant term on.
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
    0.17087277,
)


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal value is at least z."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    polynomial = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        polynomial = F.lit(c) + t * polynomial
    half = 0.5 * t * F.exp(-x * x + polynomial)
    return F.when(z >= 0, half).otherwise(1.0 - half)


def exceptional_shares(
    pairs: DataFrame, group: str, item: str, n: str, false_share: float = 0.01, flag: str = "exceptional"
) -> DataFrame:
    """``pairs`` with z, p and whether the item is exceptionally frequent in the group.

    z compares a pair's count with what the totals of its group and item lead one to expect, in standard
    deviations of the hypergeometric count; p is its upper tail.  Lift alone ranks the smallest groups first: there one
    ticket more doubles a share.  Of the flagged pairs at most ``false_share`` are expected to be
    chance (Benjamini and Hochberg): p is at most ``false_share * k / m`` for the k-th smallest of m.

    No rank over all pairs is taken: with t the cut and N(t) the pairs up to it, t = false_share * N(t) / m is
    repeated from t = false_share on.  It falls to the largest such t, which is the cut by rank; each
    step is one count over the aggregated pairs, which the caller should have stored.
    """
    by_group = pairs.groupBy(group).agg(F.sum(n).alias("_group"))
    by_item = pairs.groupBy(item).agg(F.sum(n).alias("_item"))
    total, m = pairs.agg(F.coalesce(F.sum(n), F.lit(0)), F.count(F.lit(1))).first()
    whole = F.lit(float(total))
    r, c = F.col("_group").cast("double"), F.col("_item").cast("double")
    expected = r * c / whole
    spread_ = r * c * (whole - r) * (whole - c) / (whole * whole * F.lit(float(max(total - 1, 1))))
    z = F.when(spread_ > 0, (F.col(n) - expected) / F.sqrt(spread_)).otherwise(F.lit(0.0))
    joined = null_safe_join(null_safe_join(pairs, by_group, group), by_item, item)
    scored = joined.select(*[joined[c] for c in pairs.columns], z.alias("z")).withColumn("p", upper_tail(F.col("z")))
    cut, seen = false_share, -1
    while m:
        k = scored.filter(F.col("p") <= cut).count()
        if k == seen or not k:
            break
        cut, seen = false_share * k / m, k
    return scored.withColumn(flag, F.col("p") <= F.lit(cut if m and k else -1.0))
