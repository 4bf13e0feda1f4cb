from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import recompression
from tallyframe.llm.recompression import extended, grammar, op13_periods, periodic_runs, runs_in
from tests.conftest import SF001


def brute_runs(words, least=6, exponent=4):
    """Every stretch whose words repeat after q, by the definition."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(least, exponent * q):
                found.setdefault((i, end + q - i), q)
            i = max(end, i) + 1
    return [(start, length, q) for (start, length), q in sorted(found.items(), key=lambda x: (x[0][0], x[1]))]


def numbered(words):
    numbers = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], "i4")


def test_grammar_levels_expand_to_the_words():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 500):
        words = rng.integers(0, 3, size)
        levels = grammar(words)
        for below, above in zip(levels, levels[1:]):
            assert below.first[-1] == below.symbols.size and above.symbols.size == below.first.size - 1
            seen = {}
            for i, symbol in enumerate(above.symbols.tolist()):
                children = tuple(below.symbols[below.first[i] : below.first[i + 1]].tolist())
                assert seen.setdefault(symbol, children) == children
                assert len(set(children)) == 1 if below.blocks else len(children) <= 2
        assert not levels or levels[-1].first.size == 2


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_extensions_equal_word_by_word_comparison(letters):
    rng = np.random.default_rng(letters)
    middle = np.tile(rng.integers(0, letters, 13), 9)
    words = np.concatenate([[-1], rng.integers(0, letters, 150), middle, rng.integers(0, letters, 40), [-2]])
    levels = grammar(words)
    a = rng.integers(1, words.size - 1, 800)
    b = rng.integers(1, words.size - 1, 800)
    a, b = a[a != b], b[a != b]
    for ahead, way in ((True, 1), (False, -1)):
        x, y = extended(levels, a, b, ahead)
        for i, j, got in zip(a, b, zip(x, y)):
            while words[i] == words[j]:
                i, j = i + way, j + way
            assert got == (i, j)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5), st.integers(1, 12), st.integers(2, 9))
def test_runs_equal_brute_force(texts, period, times):
    texts = [*texts, *[(t[:period] * times + t)[:150] for t in texts]]
    assert runs_in([np.array(t, "i4") for t in texts], 6, 4) == [brute_runs(t) for t in texts]


def test_one_word_repeated_and_nested_periods():
    one = ["a"] * 5000
    nested = (["a"] * 8 + ["b"]) * 30 + (["a", "c"] * 10 + ["d"]) * 6
    got = runs_in([numbered(one), numbered(nested)], 6, 4)
    assert got == [[(0, 5000, 1)], brute_runs(nested)]


def test_other_bounds():
    words = list("xababababababy")
    assert runs_in([numbered(words)], 6, 6) == [brute_runs(words, 6, 6)] == [[(1, 12, 2)]]
    assert runs_in([numbered(words)], 13, 4) == [[]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    keep = [True] * n
    for start, length, q in runs:
        keep[start + q : start + length] = [False] * (length - q)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said.encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op13_periods(spark, SF001).collect())
    assert got == sorted(expected(*row) for row in documents)
    assert sum(row[1] for row in got) > 10


def test_results_do_not_depend_on_what_is_searched_together(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b " * (i % 9) + "x y z " * (i % 7) + str(i)) for i in range(60)], "doc_id long, text string")
    whole = sorted(map(str, periodic_runs(df).collect()))
    monkeypatch.setattr(recompression, "CHARS_AT_ONCE", 1)
    assert sorted(map(str, periodic_runs(df.repartition(7)).collect())) == whole


def test_odd_rows(odd, empty):
    got = {}
    for r in periodic_runs(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[5] == [(0, [], "")] and len(got[None]) == len(got[3]) == 2
    assert got[4] == [(90_000, [(0, 90_000, 3)], "lorem ipsum dolor")]
    assert periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(odd, exponent=3)
