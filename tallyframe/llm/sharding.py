"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups (rows with equal texts) are taken by size, largest first; each enters
the open shard with the tightest remaining capacity that still holds it, found
in a balanced search tree, and a new shard opens when none does.  Equal sizes
are interchangeable and, once a shard is the tightest fit for a size, it stays
so until it is full; so a whole run of equal groups is placed per tree search
and the packing works on the table (size, number of groups).

That table is bounded whatever the input: a size keeps its ``SIZE_BITS``
leading bits, rounded up (sizes below ``2**SIZE_BITS`` are exact, others grow
by less than 1/2048), which leaves at most 2048 sizes per power of two.  Only
it reaches the driver.  Ranking the groups, looking up their shard and
numbering the rows of a shard are distributed: global numbers come from a
range sort, so neither a shard nor a hot group is gathered in one task.

Defined results: a null text counts no bytes and forms one group with the
empty text's size (its own group); repeated rows are packed once each; null
ids are kept; an empty table gives an empty result; other columns of the
input are ignored.  A group larger than an even share gets a shard of its own.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import globally_numbered, named, staged, table, text_keys

SIZE_BITS = 12
ROW_OVERHEAD = 16  # bytes a row counts beside its text


class GapTree:
    """Balanced search tree (treap) of (remaining capacity, shard).

    The heap order uses random priorities from a fixed seed, so the expected
    depth is logarithmic and results are repeatable.
    """

    __slots__ = ("root", "_random")

    def __init__(self) -> None:
        self.root: list | None = None
        self._random = random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, remaining: int, shard: int) -> None:
        key = (remaining, shard)
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._random.random(), None, None]), high)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest (remaining, shard) with remaining >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first, rest = self._split_first(high)
        self.root = self._merge(low, rest)
        return first

    def _split_first(self, node):
        if node[2] is None:
            return node[0], node[3]
        first, node[2] = self._split_first(node[2])
        return first, node


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Pack runs of equal groups; ``sizes`` holds (size, groups), largest first.

    Returns (groups, shard) in the order of the groups, so consecutive
    entries cover consecutive groups.  A group over ``capacity`` fills a
    shard alone.
    """
    tree, shards, placed = GapTree(), 0, []
    for size, groups in sizes:
        while groups:
            gap = tree.pop_tightest(size)
            if gap is None:
                gap = (max(capacity, size), shards)
                shards += 1
            remaining, shard = gap
            fits = min(groups, remaining // size)
            placed.append((fits, shard))
            groups -= fits
            if remaining - fits * size:
                tree.add(remaining - fits * size, shard)
    return placed


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """The packing with the smallest capacity found that needs at most ``shards``.

    Groups over an even share of what is left first take a shard each; for
    the others the capacity is raised from the even share until best-fit
    decreasing needs no further shard, then narrowed by bisection.
    """
    alone, rest, left = [], [list(s) for s in sizes], shards
    total = sum(size * groups for size, groups in sizes)
    while rest and left > 1 and rest[0][0] * left > total:
        alone.append((1, len(alone)))
        total -= rest[0][0]
        left -= 1
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return alone
    runs = [(size, groups) for size, groups in rest]

    def tried(capacity: int) -> list[tuple[int, int]] | None:
        placed = best_fit_decreasing(runs, capacity)
        return placed if max(shard for _, shard in placed) < left else None

    low, step = max(-(-total // left), runs[0][0]), 1
    best, high = tried(low), low
    while best is None:
        high = low + step
        best, step = tried(high), step * 2
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        found = tried(middle)
        if found is None:
            low = middle
        else:
            best, high = found, middle
    return alone + [(groups, shard + len(alone)) for groups, shard in best]


def size_class(size: Column) -> Column:
    """``size`` rounded up to ``SIZE_BITS`` leading bits."""
    bits = F.greatest(F.length(F.bin(size)) - F.lit(SIZE_BITS), F.lit(0))
    unit = F.pow(F.lit(2.0), bits).cast("long")
    return F.ceil(size / unit).cast("long") * unit


def shard_documents(
    documents: DataFrame, shards: int | None = None, capacity: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row with its shard: (doc_id, size, text_crc32, shard, slot).

    Give ``shards`` (even sizes over at most that many) or ``capacity``
    (fewest shards of that many bytes).  ``slot`` numbers a shard's rows
    without gaps.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        named(documents, doc_id=id_col, text=text_col).select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *text_keys(F.col("text")),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = globally_numbered(
        rows.groupBy("k1", "k2")
        .agg(F.sum("size").alias("group_size"))
        .select("k1", "k2", size_class(F.col("group_size")).alias("size_class")),
        [F.col("size_class").desc(), F.col("k1"), F.col("k2")],
        "shard-groups",
    )
    sizes = [(r["size_class"], r["count"]) for r in groups.groupBy("size_class").count().collect()]
    sizes.sort(reverse=True)
    placed = [] if not sizes else pack_into(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    ends = np.cumsum([groups_ for groups_, _ in placed])
    shard_of = np.array([shard for _, shard in placed], dtype="int32")

    @F.pandas_udf("int")
    def shard_at(index: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in index:
            yield pd.Series(shard_of[np.searchsorted(ends, numbers.to_numpy(), side="right")])

    where = groups.select("k1", "k2", shard_at("idx").alias("shard"))
    numbered = globally_numbered(
        rows.join(where, ["k1", "k2"]).select("doc_id", "size", "text_crc32", "shard", "row"),
        [F.col("shard"), F.col("row")],
        "shard-slots",
    )
    first = numbered.groupBy("shard").agg(F.min("idx").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("idx") - F.col("first")).alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near-equal bytes."""
    packed = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
