"""Periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that holds at least ``exponent`` periods and ``least`` words, and
that no neighbouring word extends keeping the period.

The words of some texts, with a sign of its own between any two, are one string.
Block compression (a maximal block of one symbol becomes a symbol) and pair
compression (symbols are dealt into left and right ones; every left-right pair
becomes a symbol) alternate until one symbol is left: a run-length grammar whose
levels parse equal stretches equally but for a symbol at either border.  The
longest common extension of two places goes up the levels while the symbols
agree and at most one step aligns both places with their parents, and then
down to the first words that differ: one step a level, for all queries at once.

Candidates come from the harmonic grid: a run with period q and four periods
has its first multiple i of q at least three cells before its end, so the grid
signs at i, i+q, i+2q and i+3q are equal, as are the two words after i and i+q.
Extending (i, i+q) both ways gives the run's exact borders.  Candidates inside a
known run whose period divides q can only give that run again and are left
out, period by period in bands that double, so a text of one word costs about its
length.  A grammar is built for texts with a candidate; the others have no query.

Each text is a row of its own; memory is bounded by ``CHARS_AT_ONCE`` and the longest
text.  Words are the parts between ``[\\x20\\x09-\\x0D]+``.

Defined results: null and empty texts have no words, no runs and collapse to an
empty text; repeated rows and null ids are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyframe.llm.common import give_back, named, table

CHARS_AT_ONCE = 1 << 20  # of texts that are searched together
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]))


class Level(NamedTuple):
    """One level of the grammar: its symbols, each one's parent, each parent's first child
    (one more entry ends the last), and whether the parents are blocks."""

    symbols: np.ndarray
    up: np.ndarray
    first: np.ndarray
    blocks: bool


def renamed(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1]


def grouped(symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> Level:
    """The level whose parents begin at the flagged places."""
    return Level(symbols, np.cumsum(starts) - 1, np.append(np.flatnonzero(starts), symbols.size), blocks)


def grammar(words: np.ndarray) -> list[Level]:
    """Levels from the words up; the last level's parent is the one start symbol."""
    levels, symbols = [], renamed(words)
    deal = np.random.default_rng(1)
    while symbols.size > 1:
        starts = np.append(True, symbols[1:] != symbols[:-1])
        if not starts.all():
            levels.append(grouped(symbols, starts, True))
            first = levels[-1].first
            lengths = np.diff(first)
            symbols = renamed(symbols[first[:-1]] * (lengths.max() + 1) + lengths)
            continue
        size = int(symbols.max()) + 1
        left = deal.integers(0, 2, size).astype(bool)[symbols]
        pairs = left[:-1] & ~left[1:]
        other = ~left[:-1] & left[1:]
        if other.sum() > pairs.sum():
            pairs = other
        if not pairs.any():
            continue
        starts = np.append(True, ~pairs)
        levels.append(grouped(symbols, starts, False))
        first = levels[-1].first[:-1]
        second = np.append(symbols, 0)[first + 1] + 1
        symbols = renamed(symbols[first] * (size + 1) + np.where(np.append(pairs, False)[first], second, 0))
    return levels


def extended(levels: list[Level], a: np.ndarray, b: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first places from ``a`` and ``b`` on (or back) whose words differ.

    Signs of their own stand at both ends, so there always are such places.
    """
    a, b, way = a.copy(), b.copy(), 1 if ahead else -1
    reached = np.zeros(a.size, int)  # the level where the symbols differ

    def left_in(level: Level, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the parent from here on, and whether the place is its first in this direction."""
        parent = level.up[at]
        begin, end = level.first[parent], level.first[parent + 1]
        return (end - at, at == begin) if ahead else (at - begin + 1, at == end - 1)

    rising = np.arange(a.size)
    for number, level in enumerate(levels):
        reached[rising] = number
        rising = rising[level.symbols[a[rising]] == level.symbols[b[rising]]]
        (rest_a, first_a), (rest_b, first_b) = left_in(level, a[rising]), left_in(level, b[rising])
        step = np.minimum(rest_a, rest_b) if level.blocks else np.ones(rising.size, int)
        step[first_a & first_b] = 0
        a[rising] += way * step
        b[rising] += way * step
        if level.blocks:  # the shorter rest ends where the longer one goes on
            rising = rising[(step == 0) | (rest_a == rest_b)]
        if not rising.size:
            break
        a[rising], b[rising] = level.up[a[rising]], level.up[b[rising]]
    for number in range(int(reached.max(initial=0)) - 1, -1, -1):
        level = levels[number]
        down = np.flatnonzero(reached > number)
        for at in (a, b):
            at[down] = level.first[at[down]] if ahead else level.first[at[down] + 1] - 1
        down = down[level.symbols[a[down]] == level.symbols[b[down]]]
        if level.blocks:
            step = np.minimum(left_in(level, a[down])[0], left_in(level, b[down])[0])
        else:
            step = 1
        a[down] += way * step
        b[down] += way * step
    return a, b


def on_grid(words: np.ndarray, period: int, periods: int) -> np.ndarray:
    """Multiples of the period that may be the first one in a run of so many periods."""
    grid = words[::period]
    same = grid[:-1] == grid[1:]
    found = same[: same.size - periods + 2].copy()
    for further in range(1, periods - 1):
        found &= same[further : same.size - periods + 2 + further]
    at = np.flatnonzero(found) * period
    for word in (1, 2):
        if at.size:
            at = at[words[at + word] == words[at + period + word]]
    return at


def runs_in(texts: list[np.ndarray], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period; the texts are word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, words in enumerate(texts) if words.size >= least), key=lambda i: -texts[i].size)
    if not order:
        return out
    sizes = np.array([texts[i].size for i in order])

    def joined(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts as one string with signs of their own around each, and where each begins."""
        lengths = sizes[chosen]
        begins = np.append(0, np.cumsum(lengths + 1)) + 1
        words = np.empty(begins[-1] + 3, "i4")  # the grid's further words may lie after the last
        words[begins - 1] = -1 - np.arange(begins.size)
        words[-3:] = -1 - begins.size - np.arange(3)
        for begin, i in zip(begins, chosen):
            words[begin : begin + sizes[i]] = texts[order[i]]
        return words, begins

    def candidates(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray, period: int) -> np.ndarray:
        """In the texts that can hold a run of the period, which come first."""
        enough = int(np.searchsorted(-lengths, -max(least, exponent * period), side="right"))
        return on_grid(words[: begins[enough] + 2], period, exponent) if enough else np.empty(0, int)

    words, begins = joined(np.arange(sizes.size))
    wanted = np.zeros(sizes.size, bool)
    for period in range(1, int(sizes[0]) // exponent + 1):
        at = candidates(words, begins, sizes, period)
        if at.size:
            wanted[np.searchsorted(begins, at, side="right") - 1] = True
    if not wanted.any():
        return out

    chosen = np.flatnonzero(wanted)
    words, begins = joined(chosen)
    lengths = sizes[chosen]
    levels = grammar(words)
    known = np.full(words.size, -1)  # a run that covers the place, of one band the longest
    periods = np.empty(0, int)
    found: dict[tuple[int, int], int] = {}
    low, last = 1, int(lengths[0]) // exponent
    while low <= last:
        band = range(low, min(2 * low - 1, last) + 1)
        pieces = [candidates(words, begins, lengths, period) for period in band]
        period = np.repeat(np.array(band), [p.size for p in pieces])
        at = np.concatenate(pieces)
        of = known[at]
        if periods.size:
            new = (of < 0) | (known[at + period] != of) | (period % periods[of] != 0)
            at, period = at[new], period[new]
        if low == 1 and at.size:  # of the places in one stretch of equal words the first
            first = np.append(True, np.diff(at) != 1)
            at, period = at[first], period[first]
        if at.size:
            _, end = extended(levels, at, at + period, True)
            start, _ = extended(levels, at - 1, at + period - 1, False)
            start += 1
            long = end - start >= np.maximum(least, exponent * period)
            new_runs = []
            for run in sorted(set(zip(period[long].tolist(), start[long].tolist(), end[long].tolist()))):
                if run[1:] not in found:  # else a multiple of its period
                    found[run[1:]] = run[0]
                    new_runs.append(run)
            if new_runs:
                number = periods.size
                periods = np.append(periods, [run[0] for run in new_runs])
                for k in sorted(range(len(new_runs)), key=lambda k: new_runs[k][2] - new_runs[k][1]):
                    known[new_runs[k][1] : new_runs[k][2]] = number + k
        low *= 2
    for (start, end), period in sorted(found.items(), key=lambda run: (run[0][0], run[1])):
        text = int(np.searchsorted(begins, start, side="right")) - 1
        out[order[chosen[text]]].append((start - int(begins[text]), end - start, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those after a run's first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def searched(batches: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    """For each batch (id, text): (id, n_words, runs, collapsed)."""
    give_back()
    runs_type = to_arrow_type(RUNS)

    def rows(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        numbers: defaultdict = defaultdict(count().__next__)
        words = [(text or "").encode().split() for text in texts]  # bytes split at ASCII white space
        found = runs_in([np.fromiter(map(numbers.__getitem__, w), "i4", len(w)) for w in words], least, exponent)
        listed = [[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in found]
        left = [collapsed(w, runs) for w, runs in zip(words, found)]
        arrays = [ids, pa.array([len(w) for w in words], pa.int64()), pa.array(listed, runs_type), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "runs", "collapsed"])

    for batch in batches:
        ids, texts, at = batch.column(0), batch.column(1), 0
        while at < batch.num_rows:
            part: list[str | None] = []
            chars = 0
            while at + len(part) < batch.num_rows and (not part or chars < CHARS_AT_ONCE):
                part.append(texts[at + len(part)].as_py())
                chars += len(part[-1] or "")
            yield rows(ids.slice(at, len(part)), part)
            at += len(part)


def periodic_runs(
    documents: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row with its runs: (id_col, n_words, runs, collapsed).

    ``runs`` is an array of (start, length, period) in words, ordered by start and period;
    ``collapsed`` the text without the repeated words.
    """
    if exponent < 4 or least < 3:
        raise ValueError("the grid finds runs of four periods or more, and three words or more")
    rows = named(documents, id=id_col, text=text_col)
    fields = [
        T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, least, exponent)

    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def with_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the end of a tenth of the texts repeats, as op13's contract says."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = named(documents, doc_id="doc_id", text="text").withColumns({"h": hashed, "g": F.floor(hashed / 10)})
    chosen = F.when(F.col("h") % 10 == 0, words)
    n = F.size("w")
    rows = rows.withColumn("w", chosen).withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))

    def word(i: Column) -> Column:
        source = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.get("w", source.cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their periodic runs."""
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def greater(best: Column, run: Column) -> Column:  # runs come by start and period, so the first of equals stays
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", F.reduce("runs", none, greater))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Every pair of places with equal words, by the five words from each: a run's words agree with those
# one period on for at least five words.
OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda v, e: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT), 1) AS h
  FROM documents),
dealt AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM doc),
sized AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM dealt),
token AS (SELECT r, n, unnest(range(n)) AS i, a, p, w FROM sized),
word AS (SELECT r, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS x FROM token),
five AS (SELECT r, n, i, concat_ws(' ', x, lead(x, 1) OVER s, lead(x, 2) OVER s, lead(x, 3) OVER s, lead(x, 4) OVER s) AS five
  FROM word WINDOW s AS (PARTITION BY r ORDER BY i) QUALIFY lead(x, 4) OVER s IS NOT NULL),
equal AS (SELECT a.r, a.i, b.i - a.i AS q FROM five a JOIN five b ON a.r = b.r AND a.five = b.five AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT r, q, min(i) AS start, max(i) + 5 + q AS stop
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS place FROM equal) GROUP BY r, q, place),
run AS (SELECT r, start, stop - start AS length, min(q) AS period FROM island WHERE stop - start >= greatest(6, 4 * q) GROUP BY r, start, stop),
said AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY r),
best AS (SELECT r, start, length, period FROM run a
  WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.r = a.r AND (b.length * a.period > a.length * b.period
    OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))))),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS words
  FROM (SELECT r, i, x FROM word ANTI JOIN (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run) gone USING (r, i)) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST((1000 * length) // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM doc LEFT JOIN said USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
