"""Distinct counts that can be stored and added up, exactly.

A plain distinct count per day says nothing about the month: days share values.  Here each
group keeps its values as bitmaps: a value's number picks a bucket (32,768 numbers) and a bit in it.
Bitmaps of several groups are joined by a bitwise or, so one stored table answers the
distinct count of every group, of any union of groups and of the whole, without the facts.

Building is one partial aggregate per (group, bucket): a row of at most 4 KB, however often
a value occurs, so a hot value costs nothing.  Whole numbers are their own numbers; other
values get dense ones from a stored dictionary (``value_numbers``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.counts import as_list
from tallyframe.sources.stage import StageFolder

BUCKET, BITS = "bucket", "bits"
ROW_BITS = 33  # monotonically_increasing_id: partition in the upper, row in the lower bits


def value_bitmaps(df: DataFrame, groups: str | Sequence[str], value: str) -> DataFrame:
    """(groups, bucket, bits): the distinct whole numbers of ``value`` by group; NULL is no value."""
    if not isinstance(df.schema[value].dataType, T.IntegralType):
        raise TypeError(f"{value} holds no whole numbers; give its values numbers with value_numbers first")
    number = F.col(value).cast("long")
    return (
        df.filter(number.isNotNull())
        .groupBy(*as_list(groups), F.bitmap_bucket_number(number).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS))
    )


def stored_distinct(bitmaps: DataFrame, name: str, groups: str | Sequence[str] = ()) -> DataFrame:
    """Distinct values by any of the stored groups, or (without groups) over all of them."""
    by = as_list(groups)
    whole = bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    total = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(name)
    return whole.groupBy(*by).agg(total)


def value_numbers(df: DataFrame, col: str, stage: StageFolder, number: str = "number") -> DataFrame:
    """Each distinct non-NULL value of ``col`` with a number from 0, without gaps, in the values' order.

    The values are range-sorted and staged; a number is the place in the partition plus the sizes
    of the partitions before, of which one count each reaches the driver.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    placed = stage.write(
        values.repartitionByRange(F.col(col)).sortWithinPartitions(col).withColumn("_place", F.monotonically_increasing_id()),
        f"numbers-{col}",
    )
    part = F.shiftright("_place", ROW_BITS)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((row["p"], before))
        before += row["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    row = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    return numbered.select(col, (F.col("_before") + row).alias(number))
