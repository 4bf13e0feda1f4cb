"""Rows found again by their place in their file.

A verdict on some rows of a table of texts would take a join that shuffles whole
texts once its keys are too many to broadcast.  Here a row is named by its Parquet
file and its number there, which every scan finds alike, and a set of rows is one bit
a row: a bitmap of 4 KB for 32,768 rows of a file that has any.  ``BROADCAST_BLOCKS``
bitmaps, counted first, are sent to the tasks that read the files, so 128 MB choose
among a billion rows; beyond that, groups of files are read one after the other, each
with its own bitmaps, and what was chosen is staged.  Texts are never shuffled.

Defined results: rows that are repeated in a file have places of their own; a table
that is not read straight from Parquet files is staged first; no marks choose
no rows; an empty table gives an empty result.  Files stand by a 64-bit hash of their path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import staged

BROADCAST_BLOCKS = 1 << 15
POSITION = ["file", "place"]


def positioned(docs: DataFrame) -> DataFrame:
    """(row, file, place): each row as one struct, so that no operator's column can clash
    with its own, and its position."""

    def placed(df: DataFrame) -> DataFrame:
        read = df.metadataColumn("_metadata")
        row = F.struct(*[df[f"`{c}`"] for c in df.columns])
        return df.select(row.alias("row"), F.xxhash64(read["file_path"]).alias("file"), read["row_index"].alias("place"))

    if docs._jdf.queryExecution().analyzed().children().isEmpty():  # one relation, so a row of it is a row of a file
        try:
            return placed(docs)
        except AnalysisException:  # not of Parquet files
            pass
    return placed(staged(docs, "positioned"))


def bitmaps(marks: DataFrame) -> DataFrame:
    """Staged (file, block, bits) of the marked positions."""
    block = F.bitmap_bucket_number("place").alias("block")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    return staged(marks.groupBy("file", block).agg(bits), "position-bits")


def chosen(rows: DataFrame, marks: DataFrame, inside: bool, blocks: int | None = None) -> DataFrame:
    """Of ``rows``, which have a position, those inside the marked positions or those outside."""
    bound = BROADCAST_BLOCKS if blocks is None else blocks
    bits = bitmaps(marks)
    groups = max(1, -(-bits.count() // bound))
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))

    def of(some: DataFrame, known: DataFrame) -> DataFrame:
        found = some.withColumn("block", F.bitmap_bucket_number("place")).join(known, ["file", "block"], "left")
        return found.filter(marked if inside else ~marked).select(*rows.columns)

    if groups == 1:
        return of(rows, F.broadcast(bits))
    parts = []
    for group in range(groups):
        mine = F.pmod("file", F.lit(groups)) == group  # prunes files
        known = bits.filter(mine)
        # Files are dealt by hash; a group far over the bound (one huge file) is left to Spark's choice.
        known = F.broadcast(known) if known.count() <= 2 * bound else known
        parts.append(staged(of(rows.filter(mine), known), "position-rows"))
    return reduce(DataFrame.unionAll, parts)


def inside(rows: DataFrame, marks: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows whose positions are marked."""
    return chosen(rows, marks, True, blocks)


def outside(rows: DataFrame, marks: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows whose positions are not marked."""
    return chosen(rows, marks, False, blocks)

