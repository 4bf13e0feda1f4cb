"""Values joined with the intervals that hold them, from a table of any size.

A CASE chain grows with the number of bins, and a join on ``start <= value < end`` compares every
value with every interval.  Here each interval is cut into cells of a grid with cells of
1, 16, 256, ... units: where cells of one size lie whole inside the interval, they stand for
their part of it, so an interval has at most 30 cells of each size, and its cells do not overlap.
A value lies in one cell of each size.  Values meet intervals by an equi-join on
(size, cell), exactly: no residual condition, no nested loop, and intervals may
overlap, repeat or nest.

Timestamps are first counted in the coarsest of ``SPANS`` that every border is a whole number of: 60
seconds are no power of 16, so in microseconds a minute is some 90 cells, and in minutes it is one.

A value that many intervals hold gives many rows: values times intervals, where both grow.  Where only
their number is asked for (``times``), equal cells with equal labels are counted before the join, and
the rows are bounded by values times labels.

The cells are broadcast while there are at most ``BROADCAST_CELLS``, which is counted first; beyond
that both sides are shuffled by cell, and adaptive execution splits a hot one.  Values
are copied once for each size that occurs, in the task that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_CELLS = 2_000_000  # of some 30 bytes
WIDTH = 16  # cells of one size in one of the next
SIZES = 16  # sizes: WIDTH ** SIZES is beyond any long
SPANS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000)  # days to milliseconds, in microseconds


def units(column: str, dtype: T.DataType) -> Column:
    """The value as a whole number: microseconds, days or itself."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(column))
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(column)).cast("long")
    if isinstance(dtype, T.IntegralType):
        return F.col(column).cast("long")
    raise TypeError(f"{column} holds no whole numbers, dates or timestamps")


def measure(bounded: DataFrame, dtype: T.DataType) -> tuple[int, int]:
    """The coarsest of ``SPANS`` that all borders are whole numbers of (one unit if there is none), and
    how many sizes of cell the longest interval can hold then."""
    spans = SPANS if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else ()
    longest = F.max(F.col("_high").cast("double") - F.col("_low"))
    found = bounded.agg(longest, *[F.max((F.col("_low") % s != 0) | (F.col("_high") % s != 0)) for s in spans]).first()
    span = next((s for s, broken in zip(spans, found[1:]) if not broken), 1)
    length = 1.001 * (found[0] or 0) / span  # rounded up, as doubles are not exact
    return span, next((size for size in range(1, SIZES) if WIDTH**size > length), SIZES)


def in_spans(units: str, span: int) -> Column:
    """Whole spans, rounded down."""
    return F.expr(f"{units} div {span} - IF({units} % {span} < 0, 1, 0)") if span > 1 else F.col(units)


def cells_of(start: Column, end: Column, sizes: int = SIZES) -> Column:
    """Array of (size, cell) that together are the interval from start to before end, in so many sizes."""

    def at(size: int) -> tuple[Column, Column]:
        """The first cell of the size inside, and the first one that is not."""
        bits = 4 * size
        low = F.shiftright(start, bits)
        return F.when(F.shiftleft(low, bits) < start, low + 1).otherwise(low), F.shiftright(end, bits)

    def listed(size: int, low: Column, high: Column) -> Column:
        cells = F.transform(F.sequence(low, high - 1), lambda c: F.struct(F.lit(size).alias("size"), c.alias("cell")))
        return F.when(low < high, cells)

    out = []
    for size in range(sizes):
        low, high = at(size)
        if size + 1 < sizes:
            inner, outer = (c * WIDTH for c in at(size + 1))
            some = inner < outer
            out.append(F.when(some, listed(size, low, inner)).otherwise(listed(size, low, high)))
            out.append(F.when(some, listed(size, outer, high)))
        else:
            out.append(listed(size, low, high))
    return F.flatten(F.array_compact(F.array(*out)))


def in_intervals(
    df: DataFrame, value: str, intervals: DataFrame, start: str, end: str, *labels: str, times: str | None = None
) -> DataFrame:
    """Each row of ``df`` once for every interval with start <= value < end, with the intervals' ``labels``.

    Values and borders are of one type (timestamps, dates or whole numbers).  Rows without
    a value or outside all intervals, and empty or unbounded intervals, give nothing.

    With ``times``, rows that would be alike are given together, with their number in that column: a row
    comes once with the same labels for each size of cell, so its numbers are to be added.
    """
    kinds = {df.schema[value].dataType.typeName(), intervals.schema[start].dataType.typeName(), intervals.schema[end].dataType.typeName()}
    if len(kinds) > 1 and not all(isinstance(f, T.IntegralType) for f in (df.schema[value].dataType, intervals.schema[start].dataType)):
        raise TypeError(f"values and borders are of several types: {sorted(kinds)}")
    clash = {*labels, *([times] if times else [])} & set(df.columns)
    if clash:
        raise ValueError(f"labels that are columns of the values as well: {sorted(clash)}")
    low, high = (units(c, intervals.schema[c].dataType) for c in (start, end))
    # Borders in columns of their own: the cells' expressions use them many times.
    bounded = intervals.select(*labels, low.alias("_low"), high.alias("_high")).filter("_low < _high")
    span, most = measure(bounded, intervals.schema[start].dataType)
    bounded = bounded.select(*labels, *[in_spans(c, span).alias(c) for c in ("_low", "_high")])
    cells = bounded.select(*labels, F.explode(cells_of(F.col("_low"), F.col("_high"), most)).alias("_"))
    cells = cells.select(*labels, F.col("_.size").alias("_size"), F.col("_.cell").alias("_cell"))
    if times:
        cells = cells.groupBy(*labels, "_size", "_cell").agg(F.count(F.lit(1)).alias(times))
    known = cells.groupBy("_size").count().collect()  # a row for each size at most
    if sum(r["count"] for r in known) <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    sizes = F.array(*[F.lit(r["_size"]) for r in sorted(known, key=lambda r: r["_size"])]).cast("array<int>")
    placed = df.select("*", units(value, df.schema[value].dataType).alias("_unit")).filter(F.col("_unit").isNotNull())
    placed = placed.withColumn("_unit", in_spans("_unit", span))
    placed = placed.select("*", F.explode(sizes).alias("_size"))
    placed = placed.withColumn("_cell", F.expr("shiftright(_unit, 4 * _size)"))
    return placed.join(cells, ["_size", "_cell"]).select(*[df[c] for c in df.columns], *labels, *([times] if times else []))
