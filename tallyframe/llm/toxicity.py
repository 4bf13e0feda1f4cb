"""Toxicity scores of texts restored by a noisy-channel decoder.

Obfuscated words are seen as plain words sent through a channel that swaps
letters for look-alike signs, spaces letters out, repeats them or masks them.
A suspicious token becomes a lattice: for each sign the letters it may stand
for, with a channel cost each.  Viterbi decoding finds the letters with the
best sum of channel costs and of a character trigram model, which is counted
over the words of all documents.  Its alphabet is fixed (``LETTERS`` and one
sign for any other), so the counts are bounded whatever the corpus holds.

The restored words are scored by a classifier fitted on a bounded sample of
labelled rows (``MAX_TRAINING_ROWS`` in expectation, chosen by text hash,
equal texts once; never rows that are held out).  Words and their beginnings
weigh by the log-odds of toxic against clean documents; a document counts by
its strongest words, and a logistic regression on those, fitted on weights
from the other half of the sample, gives the score.

Defined results: null and empty texts score as a document without words; rows
without a label are scored all the same; null ids count as held out unless
their remainder says otherwise (null has none: not held out); repeated rows
are kept; without usable labels every score is the share of toxic rows, 0 if
there are none; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import exp, log
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import named, staged, table, text_keys, text_udf

MAX_TRAINING_ROWS = 30_000
LEAST_TOXIC = 3  # documents of a half in which a feature must occur
THRESHOLD = 0.7
COUNTED_WORDS = 400_000  # a task hands on its character counts after so many different words

# Characters of the model: a to z, Latin-1 letters, any other letter, word border.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
OTHER, EDGE = len(LETTERS), len(LETTERS) + 1
SIZE = len(LETTERS) + 2
INDEX = {letter: i for i, letter in enumerate(LETTERS)}

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SWAP_COST, MASK_COST, DROP_COST = 1.0, 2.5, 0.3  # negative log-probabilities of the channel
MARGIN = 6.0  # log-probability by which another cut of a run into words may be worse
MASKS = frozenset("*#%?")
SEPARATORS = frozenset(".-_~'`^/\\,*")
TRIM = ".,;:?\"'`()[]{}<>…«»“”„-_&%#*~^/\\"
SUSPICIOUS = re.compile(
    r"(?<![^\W\d_])(?:[^\W\d_][\W_]+){2,}[^\W\d_](?![^\W\d_])"  # letters spaced out
    r"|[^\W\d_][*#%?]+[^\W\d_]"  # masked
    r"|[\d@$!|+€£¡](?=[^\W\d_])|(?<=[^\W\d_])[\d@$!|+€£]"  # swapped
    r"|([^\W\d_])\1\1"  # drawn out
)
DRAWN_OUT = re.compile(r"(.)\1\1", re.S)
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
MEMO = 700_000  # tokens that a worker remembers; it starts anew when full
JOINTS = re.compile(f"[^\\w{re.escape(''.join({*LOOKALIKES, *MASKS}))}]|_")
LONGEST = 32  # longer tokens are not remembered


@cache
def letter_numbers() -> np.ndarray:
    """The model's number of every character, SIZE for what is no letter."""
    numbers = np.full(0x110000, SIZE, "u1")
    numbers[[c for c in range(0x110000) if chr(c).isalpha()]] = OTHER
    numbers[[ord(c) for c in LETTERS]] = range(len(LETTERS))
    return numbers


def counted(words: Counter) -> np.ndarray:
    """Counts of trigrams, as one number each, in the words made of letters only."""
    plain: Counter = Counter()
    for word, n in words.items():
        plain[word.strip(TRIM + "!")] += n
    kept = [word for word in plain if word.isalpha()]
    if not kept:
        return np.zeros(SIZE**3, "i8")
    text = np.frombuffer("  ".join(["", *kept, ""]).encode("utf-32-le"), "<u4")
    ids = np.where(text == 32, EDGE, letter_numbers()[text]).astype("i8")
    times = np.repeat([plain[word] for word in kept], [len(word) + 2 for word in kept])
    # Two borders stand before each word; the trigram that ends in the second is none of a word's.
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    inside = ((b != EDGE) | (c != EDGE))[: times.size]
    keys = ((a * SIZE + b) * SIZE + c)[: times.size]
    return np.bincount(keys[inside], weights=times[inside], minlength=SIZE**3).astype("i8")


def trigram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(trigram, n) over the words of a partition."""
    total = np.zeros(SIZE**3, "i8")
    words: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            if text:
                words.update(text.lower().split())
                if len(words) > COUNTED_WORDS:
                    total += counted(words)
                    words.clear()
    total += counted(words)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"trigram": seen, "n": total[seen]})


def character_model(documents: DataFrame) -> np.ndarray:
    """Log-probabilities [before, last, next], smoothed by shorter contexts."""
    rows = documents.select("text").mapInPandas(trigram_counts, "trigram long, n long")
    counts = np.zeros(SIZE**3)
    for row in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # at most SIZE**3
        counts[row["trigram"]] = row["n"]
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pairs, single = counts.sum(0), counts.sum((0, 1))
    probable = (single + 1) / (single.sum() + SIZE)
    probable = (pairs + 5 * probable) / (pairs.sum(1, keepdims=True) + 5)
    probable = (counts + 5 * probable) / (counts.sum(2, keepdims=True) + 5)
    return np.log(probable).astype("f4")


def lattice(token: str) -> list[list[tuple[int, float]]]:
    """For each sign of the token its (letter, cost) options; letter -1 drops the sign."""
    out, at = [], 0
    for sign, run in groupby(token):
        length = len(list(run))
        letters = [(INDEX[sign], 0.0)] if sign in INDEX else [(OTHER, 0.0)] if sign.isalpha() else []
        letters += [(INDEX[c], SWAP_COST) for c in LOOKALIKES.get(sign, "")]
        inside = 0 < at and at + length < len(token)
        drops = not letters or sign in SEPARATORS
        if sign in MASKS and inside:
            letters += [(i, MASK_COST) for i in range(26)]
        for nth in range(length):
            options = list(letters)
            if drops or (length > 2 and nth):  # a letter repeated three times or more was drawn out
                options.append((-1, DROP_COST))
            out.append(options)
        at += length
    return out


def extended(paths: dict, options: list[tuple[int, float]], model: np.ndarray) -> dict:
    """Best (score, letters) by state after one more sign; letters are (those before, last)."""
    following: dict[tuple[int, int], tuple] = {}
    for (a, b), (score, word) in paths.items():
        for letter, cost in options:
            if letter < 0:
                state, value, longer = (a, b), score - cost, word
            else:
                state, value = (b, letter), score - cost + float(model[a, b, letter])
                longer = (word, LETTERS[letter] if letter < OTHER else "�")
            if state not in following or value > following[state][0]:
                following[state] = (value, longer)
    return following


def spelled(word: tuple | None) -> str:
    letters = []
    while word is not None:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


def ended(paths: dict, model: np.ndarray) -> tuple[float, str]:
    """The best score with a border after it, and its word."""
    return max((score + float(model[a, b, EDGE]), spelled(word)) for (a, b), (score, word) in paths.items())


def decoded(token: str, model: np.ndarray) -> str:
    """The most probable plain word behind ``token``."""
    paths = {(EDGE, EDGE): (0.0, None)}
    for options in lattice(token):
        paths = extended(paths, options, model)
    return ended(paths, model)[1]


def words_within(run: str, model: np.ndarray) -> set[str]:
    """Plain words behind a run of signs that has lost its word borders.

    Borders may stand between any two signs.  A word counts if the best way to
    cut the run up to its end so that it comes last is at most ``MARGIN`` worse
    than the best way at all; the model knows trigrams only, so its first choice
    alone would miss words.  Beginnings that are further behind are given up.
    """
    out: set[str] = set()
    begun = [{(EDGE, EDGE): (0.0, None)}]  # paths by the sign that their word begins with
    for options in lattice(run):
        begun = [extended(paths, options, model) for paths in begun]
        best = max(score for paths in begun for score, _ in paths.values())
        begun = [paths for paths in begun if max(paths.values(), key=itemgetter(0))[0] >= best - MARGIN]
        ends = [ended(paths, model) for paths in begun]
        best = max(score for score, _ in ends)
        out.update(word for score, word in ends if word and score >= best - MARGIN)
        begun.append({(EDGE, EDGE): (best, None)})
    return out


def shortened(token: str) -> str:
    """Runs of one sign cut to three, beyond which they add nothing; masks stand for a letter each."""
    return LONG_RUN.sub(lambda run: run[1] * (len(run[0]) if run[1] in MASKS else 3), token)


class Restorer:
    """Words of a text with obfuscated ones restored; tokens are memoised."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, str] = {}

    def word(self, token: str) -> str:
        core = token.strip(TRIM).rstrip("!")
        if not (DRAWN_OUT if core.isalpha() else SUSPICIOUS).search(core):
            return core
        return decoded(shortened(core), self.model)

    def long_words(self, token: str) -> set[str]:
        """The word behind a token of more than ``LONGEST`` signs, and if it is
        suspicious, those between its separators."""
        core = token.strip(TRIM).rstrip("!")
        out = {self.word(token)}
        if not core.isalpha() and SUSPICIOUS.search(core):
            pieces = JOINTS.split(core)
            out.update(map(self.word, pieces), self.spaced(pieces))
        return out

    def spaced(self, tokens: list[str]) -> set[str]:
        """Words behind runs of more than three single characters."""
        out: set[str] = set()
        if sum(map((1).__eq__, map(len, tokens))) > 3:
            for single, run in groupby(tokens, lambda token: len(token) == 1):
                if single and len(spaced := "".join(run).lstrip(TRIM).rstrip(TRIM + "!")) > 3:
                    out |= words_within(shortened(spaced), self.model)
        return out

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        tokens = text.lower().split()
        known = self.known
        if len(known) > MEMO:
            known.clear()
        out = self.spaced(tokens)
        for token in set(tokens):
            if len(token) > LONGEST:
                out |= self.long_words(token)
                continue
            if token not in known:
                known[token] = self.word(token)
            out.add(known[token])
        return out - {""}


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which a language's endings leave alone."""
    return ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


def feature_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, list[int]] = {}

    def done() -> pd.DataFrame:
        return pd.DataFrame(
            [(feature, *n) for feature, n in counts.items()], columns=["feature", "c0", "t0", "c1", "t1"]
        )

    for frame in frames:
        for half, toxic, words in zip(frame["half"], frame["toxic"], frame["words"]):
            column = 2 * int(half) + int(toxic)
            for feature in {f for word in words for f in features_of(word)}:
                counts.setdefault(feature, [0, 0, 0, 0])[column] += 1
        if len(counts) > 500_000:
            yield done()
            counts.clear()
    yield done()


class Scorer:
    """Strongest words of a document by the log-odds of their features.

    Broadcast as an object, so that a worker's memos outlive its tasks.
    """

    def __init__(self, weights: dict[str, float], restorer: Restorer | None = None) -> None:
        self.weights = weights
        self.restorer = restorer
        self.values: dict[str, float] = {}  # of words, or of tokens when there is a restorer
        self.plain: dict[str, str] = {}  # the words of tokens with a value above 0

    def value(self, word: str) -> float:
        get = self.weights.get
        return max(get(f, 0.0) for f in features_of(word)) if word else 0.0

    def strongest(self, words) -> list[float]:
        values = self.values
        if len(values) > MEMO:
            values.clear()
        for word in words:
            if word not in values:
                values[word] = self.value(word)
        top = sorted((v for v in map(values.__getitem__, words) if v > 0), reverse=True)[:3]
        return [*top, *[0.0] * (3 - len(top)), 1.0]

    def strongest_of(self, text: str | None) -> list[float]:
        """``strongest`` of the restored words of ``text``, each counted once."""
        if not text:
            return [0.0, 0.0, 0.0, 1.0]
        tokens = text.lower().split()
        values, plain = self.values, self.plain
        if len(values) > MEMO:
            values.clear()
            plain.clear()
        distinct = [token for token in set(tokens) if len(token) <= LONGEST]
        found = list(map(values.get, distinct))
        if None in found:
            for i, token in enumerate(distinct):
                if found[i] is None:
                    word = self.restorer.word(token)
                    found[i] = values[token] = self.value(word)
                    if found[i] > 0:
                        plain[token] = word
        strong = {plain[token]: value for token, value in zip(distinct, found) if value > 0}
        more = (self.restorer.long_words(token) for token in set(tokens) if len(token) > LONGEST)
        for word in self.restorer.spaced(tokens).union(*more):
            strong[word] = self.value(word)
        top = sorted(strong.values(), reverse=True)[:3]
        return [*(max(v, 0.0) for v in top), *[0.0] * (3 - len(top)), 1.0]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def log_odds(toxic: int, clean: int, toxic_rows: int, clean_rows: int) -> float:
    return log((toxic + 0.1) / (toxic_rows + 1)) - log((clean + 0.1) / (clean_rows + 1))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Sample of (half, toxic, text): labelled, not held out, equal texts once (toxic if any of
    them is labelled so)."""
    usable = labels.filter((remainder(F.col("doc_id")) != 1) & F.col("toxic").isin(0, 1))
    rows = usable.count()
    kept = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(rows, 1)))
    return (
        documents.filter((remainder(F.col("doc_id")) != 1) & kept)
        .join(usable, "doc_id")
        .select("toxic", "text", *text_keys(F.col("text")))
        .groupBy("k1", "k2")
        .agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
        .select(F.pmod("k2", F.lit(2)).alias("half"), "toxic", "text")
    )


def toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_training_rows: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """Every row with its score: (doc_id, held_out, score)."""
    spark = documents.sparkSession
    documents = named(documents, doc_id=id_col, text=text_col)
    labels = named(labels, doc_id="doc_id", toxic=label_col)
    model = character_model(documents)
    sent_restorer = spark.sparkContext.broadcast(Restorer(model))

    def restored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = sent_restorer.value
        for frame in frames:
            yield pd.DataFrame(
                {
                    "half": frame["half"], "toxic": frame["toxic"],
                    "words": [sorted(restorer.words(text)) for text in frame["text"]],
                }
            )

    training = staged(
        training_rows(documents, labels, max_training_rows).mapInPandas(
            restored, "half long, toxic long, words array<string>"
        ),
        "toxicity-training",
    )
    rows = {(r["half"], r["toxic"]): r["count"] for r in training.groupBy("half", "toxic").count().collect()}
    size = [rows.get((half, toxic), 0) for half in (0, 1) for toxic in (0, 1)]  # c0, t0, c1, t1
    counts = (
        training.mapInPandas(feature_counts, "feature string, c0 long, t0 long, c1 long, t1 long")
        .groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
        .filter(F.greatest("t0", "t1", F.col("t0") + F.col("t1") - LEAST_TOXIC) >= LEAST_TOXIC)
        .orderBy("feature")
        .collect()  # of the bounded sample, each in some toxic texts
    )
    weights = [
        {r["feature"]: log_odds(r["t0"], r["c0"], size[1], size[0]) for r in counts if r["t0"] >= LEAST_TOXIC},
        {r["feature"]: log_odds(r["t1"], r["c1"], size[3], size[2]) for r in counts if r["t1"] >= LEAST_TOXIC},
    ]
    both = {
        r["feature"]: log_odds(r["t0"] + r["t1"], r["c0"] + r["c1"], size[1] + size[3], size[0] + size[2])
        for r in counts
    }

    def strengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(weights[1]), Scorer(weights[0])]  # each half by the other's weights
        for frame in frames:
            found = [scorers[int(half)].strongest(words) for half, words in zip(frame["half"], frame["words"])]
            yield pd.DataFrame(found, columns=["a", "b", "c", "d"]).assign(toxic=frame["toxic"].to_numpy())

    known = training.mapInPandas(strengths, "a double, b double, c double, d double, toxic long").toPandas()
    toxic_share = float(known["toxic"].mean()) if len(known) else 0.0
    if known["toxic"].nunique() == 2:
        beta = logistic(known[["a", "b", "c", "d"]].to_numpy(), known["toxic"].to_numpy(float))
    else:
        beta = None

    sent = spark.sparkContext.broadcast(
        (Scorer(both, Restorer(model)), None if beta is None else beta.tolist(), toxic_share)
    )

    def score_of(text: str | None) -> float:
        scorer, beta_, share = sent.value
        if beta_ is None:
            return share
        odds = sum(a * b for a, b in zip(scorer.strongest_of(text), beta_))
        return 1 / (1 + exp(-min(30.0, max(-30.0, odds))))

    score = text_udf(score_of, T.DoubleType())
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return documents.select("doc_id", held_out.alias("held_out"), score("text").alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
