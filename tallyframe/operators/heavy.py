"""Top-k over a key with very many values, by a proven cut.

``top_k(value_counts(...))`` shuffles one row per key and task; with billions of keys
that is the table itself.  ``heavy_top_k`` reads the facts twice and shuffles a bounded
summary instead:

1. each task keeps a Misra-Gries summary of ``size`` counters.  When a batch leaves more,
   the first count beyond ``size`` is subtracted from all and the counters at or below zero
   go; what was subtracted adds up to the task's error, at most rows / (size + 1).
   Summaries are merged by adding up their counters, and their errors;
2. the ``size`` keys with the largest merged counters are counted exactly, by a
   broadcast of these keys and a partial aggregate.

A key without a counter has at most the summed errors, one with a smaller counter at most
that counter more.  If the k-th exact count is greater than this bound, no other key can be
in the top k, nor tie with it, and the cut is proven.  Otherwise the next summary is as large as
the k-th count asks for.  If even ``largest`` counters prove nothing (the counts are too
even), all keys are counted, as by ``top_k``.  The result is the same in any case.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.operators.counts import by_measure, value_counts
from tallyframe.operators.joins import null_safe_join
from tallyframe.operators.topk import top_k

SIZE = 1_024  # counters of the first summary
LARGEST = 65_536  # counters of the last one; so many (key, count) rows reach the driver at most


def cut(counters: dict, size: int) -> int:
    """Leave at most ``size`` counters; returns what was subtracted from each."""
    if len(counters) <= size:
        return 0
    least = heapq.nlargest(size + 1, counters.values())[-1]
    left = {key: n - least for key, n in counters.items() if n > least}
    counters.clear()
    counters.update(left)
    return least


def summary_in(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """(key, n, error) of one task's rows; the row with an error has no counter."""
    counters: dict = {}
    error = 0
    for batch in batches:
        for found in pc.value_counts(batch.column(0)).to_pylist():
            key = found["values"]
            counters[key] = counters.get(key, 0) + found["counts"]
        error += cut(counters, size)
    columns = [[*counters, None], [*counters.values(), None], [None] * len(counters) + [error]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def merged_summary(df: DataFrame, key: str, size: int) -> tuple[list[tuple], int]:
    """The ``size`` keys with the largest counters, and how many rows any other key can have."""
    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType()), T.StructField("error", T.LongType())])
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *schema.fields[1:]])
    arrow = to_arrow_schema(schema)
    parts = df.select(key).mapInArrow(lambda it: summary_in(it, arrow, size), schema)
    # The error is one more group; a struct keeps it apart from a NULL key.
    of = F.struct(F.col("n").isNull().alias("is_error"), "key")
    merged = parts.groupBy(of.alias("of")).agg(F.sum(F.coalesce("n", "error")).alias("n"))
    rows = merged.orderBy(F.col("of.is_error").desc(), F.col("n").desc(), F.col("of.key")).limit(size + 2).collect()
    if not rows:
        return [], 0
    error, counters = rows[0]["n"], rows[1:]
    beyond = counters[size]["n"] if len(counters) > size else 0
    return [(r["of"]["key"],) for r in counters[:size]], error + beyond


def heavy_top_k(
    df: DataFrame, key: str, k: int, name: str = "n", size: int = SIZE, largest: int = LARGEST
) -> DataFrame:
    """The k most frequent values of ``key`` with their counts; ties go to the smaller key, a
    NULL key is a key.  Equal to ``top_k(value_counts(df, key, name), name, key, k)``."""
    if k < 1 or size < k:
        raise ValueError("k must be at least 1, and the summary must hold k keys")
    spark = df.sparkSession
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)])
    while size <= largest:
        keys, bound = merged_summary(df, key, size)
        candidates = F.broadcast(spark.createDataFrame(keys, schema))  # at most ``size`` rows
        counts = value_counts(null_safe_join(df.select(key), candidates, key), key, name, order=False)
        top = counts.orderBy(*by_measure(name, [key])).limit(k).collect()
        if not bound or (len(top) == k and top[-1][name] > bound):
            return spark.createDataFrame([tuple(r) for r in top], counts.schema)
        reach = top[-1][name] if len(top) == k else 1
        size = max(2 * size, min(largest, size * bound // max(1, reach) + size)) if size < largest else largest + 1
    return top_k(value_counts(df, key, name, order=False), name, key, k)
