"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of the benchmark items: 10 consecutive words, or a
whole shorter item.  Texts and patterns are lower-cased (A-Z) and joined by
single spaces, with one space around, so an occurrence starts and ends at word
borders.  The search looks at the last block of a pattern-length view of the
text: a shift table says how far the view can move when that block ends no
pattern, a suffix hash selects the patterns that end in it, and a direct
comparison confirms them.  The block length follows the pattern table's size,
so that most blocks of a text are in no pattern; patterns of very different
lengths get tables of their own, as the shortest bounds the shift.

The benchmark is the stated query set.  Its windows are counted first and
split by hash into blocks of at most ``BLOCK_BYTES``; each block is collected,
sent to the tasks and searched for in all documents, so no more than one block
is in memory, whatever the benchmark's size.

Defined results: null and empty texts have no words and are clean; items
without words have no windows; repeated items and ids count once; an item
with a null id marks words but is listed with an empty id; empty tables give
empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import named, staged, table, text_keys, text_udf

WINDOW = 10
FOLLOWERS = 8  # likely characters after a given one in prose (3 bits a character)
BLOCK_BYTES = 4 << 20  # of windows and item ids searched at once; their tables take some 16 times as much in a worker
# Word characters are digits, letters (lower-cased) and everything beyond ASCII.
_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
_FOLD[ord("0") : ord("9") + 1] = b"0123456789"
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(_FOLD)


def folded(text: str | None) -> list[bytes]:
    """The text's words; every other ASCII character has become a space."""
    return text.encode().translate(FOLD).split() if text else []


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = folded(text)
    if not words:
        return []
    last = max(1, len(words) - window + 1)
    return [b" ".join(words[i : i + window]) for i in range(last)]


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class WuManber:
    """Shift and suffix tables for patterns whose lengths are within a factor of two."""

    def __init__(self, patterns: Iterable[bytes]) -> None:
        self.patterns = sorted(set(patterns))
        self.shortest = min(map(len, self.patterns))
        block, space = 1, FOLLOWERS
        while space < 2 * self.shortest * len(self.patterns):
            block, space = block + 1, space * FOLLOWERS
        self.block = min(block, self.shortest)
        self.far = self.shortest - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.suffix: dict[bytes, list[bytes]] = {}
        for pattern in self.patterns:
            for end in range(self.block, self.shortest + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), self.shortest - end)
            key = pattern[self.shortest - self.block : self.shortest]
            self.suffix.setdefault(key, []).append(pattern)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, overlapping ones too."""
        shift, block, far, shortest, size = self.shift.get, self.block, self.far, self.shortest, len(text)
        end = shortest
        while end <= size:
            key = text[end - block : end]
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - shortest
            for pattern in self.suffix[key]:
                if text.startswith(pattern, start):
                    yield start, pattern
            end += 1


class Searcher:
    """All windows of a benchmark block: tables by length, and each window's items."""

    def __init__(self, items_of: dict[bytes, list[str]]) -> None:
        self.items_of = items_of
        classes: dict[int, list[bytes]] = {}
        for window in items_of:
            classes.setdefault(len(window).bit_length(), []).append(b" " + window + b" ")
        self.tables = [WuManber(patterns) for _, patterns in sorted(classes.items())]

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """(words, numbers of hit words, items with an occurring window)."""
        words = folded(text)
        joined = b" %b " % b" ".join(words)
        found = [hit for table_ in self.tables for hit in table_.occurrences(joined)]
        if not found or not words:
            return len(words), [], []
        starts, place = [], 0
        for word in words:
            starts.append(place)
            place += len(word) + 1
        hit: set[int] = set()
        items: set[str] = set()
        for start, pattern in found:
            first = bisect_left(starts, start)
            hit.update(range(first, first + pattern.count(b" ") - 1))
            items.update(self.items_of[pattern[1:-1]])
        return len(words), sorted(hit), sorted(items)


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(window, items): every distinct window with the ids of its items."""
    cut = text_udf(partial(windows_of, window=window), T.ArrayType(T.BinaryType()))
    return (
        named(benchmark, item_id=id_col, text=text_col)
        .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.explode(cut("text")).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", keep: dict[str, str] | None = None,
) -> DataFrame:
    """Every row with what it shares with the benchmark: the columns ``keep``
    (new name: name), n_words, hit_words (numbers of hit words), items (ids)."""
    windows = staged(benchmark_windows(benchmark, window, item_col, item_text), "benchmark-windows")
    spark = documents.sparkSession
    size = windows.agg(F.sum(F.length("window") + F.size("items") * 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = named(documents, **{**(keep or {}), "_text": text_col})
    # A text is named by its hashes, so no text is staged: a block's hits are rows of these, once a text.
    keys = [c.alias(f"_{c_}") for c, c_ in zip(text_keys(F.col("_text")), ("k1", "k2"))]
    first, others = None, []
    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(Searcher({bytes(r["window"]): r["items"] for r in part.collect()}))
        if not block:
            first = rows.select(*(keep or {}), *keys, searched(sent)("_text").alias("_hits"))
            if blocks > 1:
                first = staged(first, "benchmark-hits-0")
                sent.destroy()
            continue
        found = rows.select(*keys, searched(sent)("_text").alias("_hits")).filter(F.size("_hits.items") > 0)
        others.append(staged(found.dropDuplicates(["_k1", "_k2"]), f"benchmark-hits-{block}"))
        sent.destroy()
    fields = ("hit_words", "items")
    if not others:
        return first.select(*(keep or {}), F.col("_hits.n_words").alias("n_words"),
                            *[F.array_sort(F.array_distinct(f"_hits.{f}")).alias(f) for f in fields])
    more = reduce(DataFrame.unionAll, others).groupBy("_k1", "_k2").agg(  # a row a block at most
        *[F.flatten(F.collect_list(f"_hits.{f}")).alias(f"_{f}") for f in fields]
    )
    joined = first.join(more, ["_k1", "_k2"], "left")
    return joined.select(
        *(keep or {}), F.col("_hits.n_words").alias("n_words"),
        *[F.array_sort(F.array_distinct(F.when(F.col(f"_{f}").isNull(), F.col(f"_hits.{f}"))
                                        .otherwise(F.concat(f"_hits.{f}", f"_{f}")))).alias(f) for f in fields],
    )


def searched(sent: Broadcast) -> Callable[..., Column]:
    return text_udf(lambda text: sent.value.search(text), HITS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 10 words."""
    found = benchmark_hits(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep={"doc_id": "doc_id"}
    )
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


# Joins every document word position with the windows that start there.
OP4_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
pattern AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
  FROM documents),
place AS (
  SELECT r, w, i, size FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM doc WHERE len(w) > 0),
         (SELECT DISTINCT size FROM pattern) WHERE i + size - 1 <= len(w)),
hit AS (
  SELECT r, i, p.size, item FROM (SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM place) q
  JOIN pattern p ON p.size = q.size AND p.win = q.win),
covered AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS pos FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered c USING (r) LEFT JOIN items t USING (r)
"""
