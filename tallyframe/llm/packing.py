"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are cut into pieces of ``capacity`` tokens; full pieces are sequences
of their own, and the tails are packed by bulk-synchronous best fit.  Tails
are range-sorted by length, which gives each a rank among those of its length,
so a run (length, first rank, count) stands for any number of tails; gaps are
runs (tokens free, first sequence, count) likewise.  A round takes the longest
tails, within ``BAND`` of the longest one left.  Tasks sweep disjoint ranges
of sizes from large to small and match every tail with its successor, the
smallest gap that holds it and that no longer tail claims; conflicts go by
rank: longer tails first, then lower ranks.  At the barrier, tails that found
no gap in their range try the gaps of larger ranges that are left; for those
still without one, just enough sequences open; gaps shrink by what they took,
and the next round begins.

Lengths are below ``capacity``, so the runs of a round are bounded by it and
not by the documents: only runs travel between driver and tasks.  Ranking and
placing the tails themselves is distributed.

Token ids are staged once, beside the pieces; placing reads the narrow columns
only, and ``with_ids`` joins the ids back.

Defined results: null counts as empty; a document without tokens is its end
token alone; repeated rows and null ids are packed as rows of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tallyframe.llm.common import globally_numbered, named, staged, table, text_udf, texts_udf

CAPACITY = 4096
END_ID = 1
BAND = 0.6  # shortest tail of a round as a share of the longest
RANGES = 4  # size ranges that are swept at once
CACHED_WORDS = 180_000  # one half of a worker's memo of words
LONGEST_CACHED = 64  # characters
CHARACTERS_AT_ONCE = 2_000_000  # whose texts are encoded together
MARKS = 1 << 22  # for words that were met once
RUNS_AT_ONCE = 200  # runs of letters in one line for the model


def byte_signs() -> str:
    """The vocabulary's sign for each byte: printable Latin-1 stands for itself,
    the others follow from 256 on; but spaces stay, as they separate words."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    return "".join(chr(byte if byte in printable or byte == 0x20 else 256 + others.index(byte)) for byte in range(256))


def filled(values: list, fill: list) -> list:
    """``values`` with its empty places filled in order."""
    rest = iter(fill)
    return [next(rest) if value is None else value for value in values]


def by_length(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of about ``CHARACTERS_AT_ONCE``."""
    some, length = [], 0
    for text in texts:
        some.append(text)
        length += len(text)
        if length >= CHARACTERS_AT_ONCE:
            yield some
            some, length = [], 0
    if some:
        yield some


class WordEncoder:
    """Token ids of texts, packed as unsigned 32-bit little-endian integers.

    The vocabulary's pre-tokenizer never joins characters over a space or a
    line feed, so a text's ids are those of its space-separated words.  The
    distinct words of many texts are looked up in a memo of words that were
    met before, as most words of a corpus occur once.  It has two halves: when
    one is full, it becomes the older half, and of the older half before it
    only what was met again is kept.

    Texts within Latin-1, where the normaliser changes nothing but the case,
    are lower-cased first; there ``PARTS`` cuts a word as the pre-tokenizer
    does, and its parts go to the model itself.
    """

    SIGNS = byte_signs()
    LETTERS, DIGITS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
    PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks, self.marked = np.zeros(MARKS, bool), 0

    @cached_property
    def tokenizer(self) -> Tokenizer:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        return Tokenizer.from_file(self.path)

    @cached_property
    def model(self):
        return self.tokenizer.model

    @cached_property
    def alone(self) -> Tokenizer:
        """The model for runs of letters between spaces."""
        alone = Tokenizer(self.model)
        alone.pre_tokenizer = CharDelimiterSplit(" ")
        return alone

    @cached_property
    def last(self) -> np.ndarray:
        """Whether a token is the last one of a run."""
        vocabulary, suffix = self.tokenizer.get_vocab(), self.model.end_of_word_suffix
        last = np.zeros(1 + max(vocabulary.values()), bool)
        last[[number for token, number in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        return last

    def __reduce__(self):
        """Sent as the path alone; a worker loads the vocabulary when it first encodes."""
        return WordEncoder, (self.path,)

    def encoded(self, texts: list[str]) -> list[bytes]:
        kinds = [self.is_plain(text) for text in texts]
        ids = {kind: iter(self.joined([text.lower() if kind else text for text, k in zip(texts, kinds) if k is kind], kind)) for kind in set(kinds)}
        return [next(ids[kind]) for kind in kinds]

    def is_plain(self, text: str) -> bool:
        if "<|" in text:  # special tokens are matched before the case changes
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def joined(self, texts: list[str], plain: bool) -> list[bytes]:
        split = pc.split_pattern(pa.array([text.replace("\n", " ") for text in texts], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        ids = self.looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), plain)
        words = pa.array(ids, pa.large_binary()).take(coded.indices)
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, words), pa.scalar(b"", pa.large_binary())).to_pylist()

    def looked_up(self, words: list[str], plain: bool) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, words))
        missed = [word for word, old in zip(words, ids) if old is None]
        again = list(map(self.older.get, missed))
        self.known.update([(word, old) for word, old in zip(missed, again) if old is not None])
        learn = [word for word, old in zip(missed, again) if old is None]
        new = self.plain(learn) if plain else list(map(self.any, learn))
        self.known.update([
            (word, found) for word, found, met in zip(learn, new, self.met_before(learn)) if met and len(word) <= LONGEST_CACHED
        ])
        return filled(ids, filled(again, new))

    def met_before(self, words: list[str]) -> list[int]:
        """0 for most words that are met for the first time."""
        if self.marked > MARKS // 4:
            self.marks[:], self.marked = 0, 0
        at = np.fromiter(map(hash, words), "i8", len(words)) % MARKS
        met = self.marks[at].tolist()
        self.marks[at] = 1
        self.marked += len(words) - sum(met)
        return met

    def any(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def plain(self, words: list[str]) -> list[bytes]:
        cores = [word.rstrip(".,") for word in words]
        runs = iter(self.runs([core for core in cores if core.isalpha()]))
        return [
            (next(runs) if core == word else next(runs) + self.mark(word[len(core) :])) if core.isalpha() else self.parts(word)
            for word, core in zip(words, cores)
        ]

    def runs(self, runs: list[str]) -> list[bytes]:
        lines = [self.signs(" ".join(runs[at : at + RUNS_AT_ONCE])) for at in range(0, len(runs), RUNS_AT_ONCE)]
        found = self.alone.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(line.ids for line in found), "<u4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(ends) != len(runs):  # a vocabulary that does not mark them
            return list(map(self.letters, runs))
        packed = ids.tobytes()
        return [packed[start:end] for start, end in zip([0, *ends], ends)]

    def letters(self, run: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(self.signs(run))]).tobytes()

    def signs(self, runs: str) -> str:
        return charmap_decode(runs.encode(), "strict", self.SIGNS)[0]

    def parts(self, word: str) -> bytes:
        return b"".join([self.letters(part) if part.isalpha() else self.mark(part) for part in self.PARTS.findall(word)])

    def mark(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            ids = self.any(part)
            if len(part) <= LONGEST_CACHED:
                self.known[part] = ids
        return ids

    def all_pieces(self, texts: Iterable[str | None], capacity: int, end_id: int) -> Iterator[list[bytes]]:
        end = end_id.to_bytes(4, "little")
        for some in by_length(text or "" for text in texts):
            for ids in self.encoded(some):
                ids += end
                yield [ids[at : at + 4 * capacity] for at in range(0, len(ids), 4 * capacity)]

    def pieces(self, text: str | None, capacity: int, end_id: int) -> list[bytes]:
        return next(self.all_pieces([text], capacity, end_id))


def sweep(tails: list[tuple], gaps: list[tuple]) -> tuple[list, list, list, list]:
    """Match runs of tails (length, rank, count) with runs of gaps (free, sequence,
    count), both largest first; equal tails share a gap as long as they fit.

    Returns matches (length, rank, tails, tails a gap, sequence, free before),
    tails left, gaps left, and the new gaps.
    """
    matches, tails_left, new, open_ = [], [], [], []
    next_gap = 0
    for length, rank, count in tails:
        while next_gap < len(gaps) and gaps[next_gap][0] >= length:
            open_.append(gaps[next_gap])
            next_gap += 1
        while count and open_:
            free, first, gap_count = open_.pop()
            share = min(free // length, count)
            used = min(count // share, gap_count)
            matches.append((length, rank, used * share, share, first, free))
            if free > share * length:
                new.append((free - share * length, first, used))
            if used < gap_count:
                open_.append((free, first + used, gap_count - used))
            rank, count = rank + used * share, count - used * share
        if count:
            tails_left.append((length, rank, count))
    return matches, tails_left, open_ + gaps[next_gap:], new


def by_size(runs) -> list[tuple]:
    return sorted(runs, key=lambda run: (-run[0], run[1]))


def in_ranges(tails: list[tuple], gaps: list[tuple]) -> list[tuple[list, list]]:
    """Sizes cut into ranges of about as many tail runs: (tails, gaps) of each."""
    step = -(-len(tails) // RANGES)
    parts = [tails[at : at + step] for at in range(0, len(tails), step)]
    out, rest = [], gaps
    for part in parts:
        low = part[-1][0]
        inside = [gap for gap in rest if gap[0] >= low]
        rest = rest[len(inside) :]
        out.append((part, inside))
    return out


swept = text_udf(lambda part: json.dumps(sweep(*json.loads(part))), T.StringType())


def best_fit_rounds(spark: SparkSession, counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Matches of all tails given their number by length, and the number of sequences."""
    tails = by_size((length, 0, count) for length, count in counts.items())
    gaps: list[tuple] = []
    matches: list[tuple] = []
    sequences = 0
    while tails:
        shortest = tails[0][0] * BAND
        now = [run for run in tails if run[0] >= shortest]
        later = tails[len(now) :]
        gaps = by_size(gaps)
        usable = [gap for gap in gaps if gap[0] >= now[-1][0]]
        waiting, new, left = [], [], []
        if usable:
            parts = in_ranges(now, usable)
            sent = spark.createDataFrame([(json.dumps(part),) for part in parts], "part string")
            for row in sent.select(swept("part").alias("done")).collect():
                found, tails_left, gaps_left, shrunk = json.loads(row["done"])
                matches += found
                waiting += tails_left
                left += gaps_left
                new += shrunk
            found, waiting, left, shrunk = sweep(by_size(waiting), by_size(left))
            matches += found
            new += shrunk
        else:
            waiting = now
        gaps = left + new + gaps[len(usable) :]
        widest = max((gap[0] for gap in gaps), default=0)
        homeless = sum(length * count for length, _, count in waiting if length > widest)
        if homeless:
            opened = -(-homeless // capacity)
            gaps.append((capacity, sequences, opened))
            sequences += opened
        tails = by_size(waiting + later)
    return matches, sequences


def tokenised(
    documents: DataFrame, capacity: int, tokenizer: str, id_col: str, text_col: str, end_id: int
) -> DataFrame:
    """Staged pieces (row, doc_id, piece, start, length, ids_crc32, ids)."""
    # Broadcast, so that a worker's memo outlives its tasks, but not this job.
    sent = documents.sparkSession.sparkContext.broadcast(WordEncoder(tokenizer))
    cut = texts_udf(lambda texts: sent.value.all_pieces(texts, capacity, end_id), T.ArrayType(T.BinaryType()))
    return staged(
        named(documents, doc_id=id_col, text=text_col)
        .select("doc_id", F.posexplode(cut("text")).alias("piece", "ids"))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "piece",
            (F.col("piece").cast("long") * capacity).alias("start"),
            (F.octet_length("ids") / 4).cast("long").alias("length"),
            F.crc32("ids").alias("ids_crc32"), "ids",
        ),
        "packing-pieces",
    )


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset), and the packed ids if asked for."""
    spark = documents.sparkSession
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = tokenised(documents, capacity, path, id_col, text_col, end_id)
    narrow = pieces.drop("ids")
    tails = globally_numbered(
        narrow.filter(F.col("length") < capacity), [F.col("length").desc(), F.col("row")], "packing-tails"
    )
    counts = {r["length"]: r["count"] for r in tails.groupBy("length").count().collect()}  # < capacity rows
    matches, sequences = best_fit_rounds(spark, counts, capacity)
    first, total = {}, 0
    for length in sorted(counts, reverse=True):
        first[length] = total
        total += counts[length]
    runs = sorted((first[m[0]] + m[1], *m) for m in matches)
    start, length, _, count, share, sequence, free = (
        np.array(column, "i8") for column in (zip(*runs) if runs else [[]] * 7)
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(index: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for numbers in index:
            at = numbers.to_numpy()
            run = np.searchsorted(start, at, side="right") - 1
            nth = at - start[run]
            offset = capacity - free[run] + nth % share[run] * length[run]
            yield pd.DataFrame({"sequence_id": sequence[run] + nth // share[run], "offset": offset})

    columns = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    whole = narrow.filter(F.col("length") == capacity).select(
        *columns, (F.col("row") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    out = tails.select(*columns, place("idx").alias("_")).select(*columns, "_.*").unionByName(whole)
    if with_ids:
        out = out.join(pieces.select("row", "ids"), "row")
    return out.drop("row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
