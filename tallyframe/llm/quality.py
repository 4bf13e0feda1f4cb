"""Quality rules: word statistics of a text and cross-document line frequency.

Lines are normalised (lower case, digits as one sign, runs of white space as
one space, no outer punctuation), hashed, and counted in distinct documents
per host.  A document is a distinct text here, so exact copies, which
deduplication handles, do not make their own lines frequent.  A line above the
limit of its host is removed wherever it stands in that host; a document
that loses too much or keeps too few words is rejected.

The limit is the same for every host, more than ``LINE_FLOOR`` distinct documents;
``LINE_SHARE``, a share of the host's distinct documents to exceed as well, is 0.

Scale: one pass over the texts yields the statistics and (line hash, words)
lists, which are staged; the texts are not read again for the counting.  The
counts are partial aggregates, so a host or line that holds a third of all
rows reaches a task as one row per map task and key.  The lines above a limit
are staged before they are joined, so Spark broadcasts them only when their
known size is under its threshold and otherwise splits skewed partitions.

Defined results: null and empty texts have no words and fail the base; a null
host is a host of its own; repeated rows are judged alike and kept as rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import named, staged, table, text_udf
from tallyframe.llm.positions import POSITION, inside, outside, positioned

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
LINE_FLOOR = 30  # distinct documents of a host
LINE_SHARE = 0.0  # of the host's distinct documents
MAX_REMOVED = 0.8  # of a document's words, however many are left
MAX_REMOVED_SHORT = 0.5  # of its words, if under MIN_WORDS are left
SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(r"\d+")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BROADCAST_NUMBERS = 4_000_000  # keys, verdicts and places together
STATISTICS = T.StructType(
    [T.StructField(name, T.LongType()) for name in COUNTS]
    + [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.LongType()))]
)


def normalised_line(line: str) -> str:
    """The form in which lines of different documents are compared."""
    return DIGITS.sub("0", " ".join(line.lower().split())).strip(" .,;:!?-*#|")


def line_hash(line: str) -> int:
    value = xxhash.xxh64_intdigest(normalised_line(line).encode())
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), "i8", len(words))
    size = len(numbers)
    if len(words) == size:
        return 0
    if size**WINDOW < 1 << 62:
        key = np.zeros(n, "i8")
        for i in range(WINDOW):
            key = key * size + ids[i : i + n]
    else:  # number the pairs, then the fours, so that keys stay exact
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2] * (int(pair.max()) + 1) + pair[2:], return_inverse=True)[1]
        key = four[:n] * size + ids[WINDOW - 1 :]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[where] > 1)
    if not twice.size:
        return 0
    covered = np.zeros(len(words) + 1, "i8")
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def statistics(text: str | None) -> tuple:
    """The five counts, then hash (null without words) and words of each line."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    words = text.encode().split()
    seen, repeated, hashes, sizes = set(), 0, [], []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            repeated += line in seen
            seen.add(line)
        hashes.append(line_hash(line) if n else None)
        sizes.append(n)
    chars = len(b"".join(words).decode())
    return len(words), chars, len(SYMBOLS.findall(text)), repeated, repeated_words(words), hashes, sizes


statistics_of = text_udf(statistics, STATISTICS)


def frequent_lines(rows: DataFrame, floor: int = LINE_FLOOR, share: float = LINE_SHARE) -> DataFrame:
    """(host, hash): lines in more distinct documents of their host than its limit."""
    lines = rows.select("host", "text_hash", F.explode("hashes").alias("hash")).filter("hash is not null")
    counts = lines.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") > floor)
    hosts = (
        rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("documents"))
        .withColumnRenamed("host", "of")
    )
    over = counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.col("documents") * share)
    return staged(over.select("host", "hash"), "quality-lines")


def removed_lines(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, removed words, places of removed lines) of the rows that lose any."""
    lines = rows.select("row", "host", F.posexplode(F.arrays_zip("hashes", "words")).alias("place", "_")).select(
        "row", "host", "place", F.col("_.hashes").alias("hash"), "_.words"
    )
    above = frequent.toDF("of", "above")
    hit = lines.join(above, (F.col("hash") == F.col("above")) & F.col("host").eqNullSafe(F.col("of")), "left_semi")
    return hit.groupBy("row").agg(F.sum("words").alias("removed"), F.collect_list("place").alias("places"))


def judged(
    documents: DataFrame, keep: dict[str, str], text_col: str = "text", host_col: str = "source",
    floor: int = LINE_FLOOR, share: float = LINE_SHARE,
) -> DataFrame:
    """Every row's columns ``keep`` (new name: name), statistics, base_failed, kept,
    and the places of its lines above the limit (null if none)."""
    rows = named(documents, **keep, _text=text_col, host=host_col).withColumn("_", statistics_of("_text"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), *keep, "host", F.xxhash64("_text").alias("text_hash"), "_.*"
    )
    rows = staged(rows, "quality-statistics")
    lost = removed_lines(rows, frequent_lines(rows, floor, share))
    removed = F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words")
    )
    left = F.col("n_words") - removed
    most = F.when(left < MIN_WORDS, F.lit(MAX_REMOVED_SHORT)).otherwise(F.lit(MAX_REMOVED))
    enough = removed <= F.col("n_words") * most
    return rows.join(lost, "row", "left").select(
        *keep, *COUNTS, failed.alias("base_failed"), (~failed & enough).alias("kept"),
        removed.alias("n_removed_words"), "places",
    )


def cleaned(documents: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``documents`` without the rejected ones and without the lines above the limit.

    A verdict finds its row by position.  The verdicts other than "keep as it is" are
    broadcast while they hold at most ``BROADCAST_NUMBERS``, counted first; beyond that the
    rows without one pass by bitmaps of positions, and only rows that lose lines are shuffled.
    """
    names = documents.columns
    rows = positioned(documents)
    rows = rows.select(*POSITION, "row", F.col("row")[text_col].alias("text"), F.col("row")[host_col].alias("host"))
    verdicts = judged(rows, {c: c for c in POSITION}, host_col="host")
    verdicts = staged(
        verdicts.filter(~F.col("kept") | F.col("places").isNotNull()).select(*POSITION, "kept", "places"), "quality-verdicts"
    )
    numbers = verdicts.agg(F.sum(F.lit(4) + F.coalesce(F.size("places"), F.lit(0)))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        out = rows.join(F.broadcast(verdicts), POSITION, "left").filter(F.coalesce("kept", F.lit(True)))
    else:
        positions = rows.select(*POSITION, "row")
        shorter = verdicts.filter("kept")
        out = inside(positions, shorter).join(shorter, POSITION).select("row", "places").unionByName(
            outside(positions, verdicts).select("row"), allowMissingColumns=True
        ).withColumn("text", F.col("row")[text_col])
    lines = F.filter(F.split("text", "\n", -1), lambda _, place: ~F.array_contains("places", place))
    shorter = F.when(F.col("places").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text"))
    return out.select(*[shorter.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"), {"doc_id": "doc_id"}).drop("places")


# Lines are compared as normalised strings; a line's place in its document is kept.
OP2_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
word AS (SELECT r, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') AS w FROM doc),
line AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM doc),
real AS (
  SELECT r, source, text, line, i, len(list_filter(regexp_split_to_array(line, '[ 	-
]+'), lambda x: x <> '')) AS n,
         trim(regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '\d+', '0', 'g'), ' .,;:!?-*#|') AS norm
  FROM line WHERE regexp_matches(line, '[^ 	-
]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY r),
host AS (SELECT source, count(DISTINCT text) AS documents FROM doc GROUP BY source),
frequent AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM real GROUP BY source, norm) JOIN host USING (source)
  WHERE n > {LINE_FLOOR} AND n > documents * {LINE_SHARE}),
lost AS (SELECT r, sum(n) AS removed FROM real JOIN frequent USING (source, norm) GROUP BY r),
win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' ') AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW} + 1)) AS i FROM word)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + {WINDOW} - 1)) AS p FROM twice) GROUP BY r),
stat AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words
  FROM doc JOIN word USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM stat)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_removed_words <= n_words * CASE WHEN n_words - n_removed_words < {MIN_WORDS}
         THEN {MAX_REMOVED_SHORT} ELSE {MAX_REMOVED} END AS kept, n_removed_words
FROM judged
"""
