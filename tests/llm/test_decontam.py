from __future__ import annotations

import random

import pytest

import tallyframe.llm.decontam as decontam
from tallyframe.llm.common import staged
from tallyframe.llm.decontam import WuManber, benchmark_hits, folded, windows_of


@pytest.mark.parametrize("seed", range(60))
def test_wu_manber_finds_every_occurrence(seed):
    rng = random.Random(seed)
    patterns = {bytes(rng.choices(b"ab c", k=rng.randint(3, 7))) for _ in range(rng.randint(1, 9))}
    text = bytes(rng.choices(b"ab c", k=300))
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert sorted(WuManber(patterns).occurrences(text)) == want


def test_words_and_windows():
    assert folded("Ab-1é_Ünï x{Y}") == [w.encode() for w in ["ab", "1é", "Ünï", "x", "y"]]
    assert windows_of("a b c") == [b"a b c"] and windows_of(None) == windows_of("--") == []
    assert len(windows_of(" ".join("abcdefghijkl"))) == 3


def brute_force(text, items):
    words = folded(text)
    hit, found = set(), set()
    for item, item_text in items:
        for window in windows_of(item_text):
            size = window.count(b" ") + 1
            for i in range(len(words) - size + 1):
                if b" ".join(words[i : i + size]) == window:
                    hit.update(range(i, i + size))
                    found.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_hits_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)  # 60 bytes: many blocks of patterns
    rng = random.Random(2)
    word = lambda: rng.choice(["aa", "b", "cc", "Dd", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 14])))) for i in range(6)]
    items += [(None, "zz yy"), (3, "twice given id"), (9, None), (10, "..."), (11, "zz yy")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    texts += [None, "", "ZZ, yy! twice GIVEN id", f"x {items[4][1].upper()} x", "zz yyy", *[items[5][1]] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    written = []
    monkeypatch.setattr(decontam, "staged", lambda df, name: written.append(df.columns) or staged(df, name))
    got = {r.doc_id: (r.n_words, r.hit_words, r["items"]) for r in
           benchmark_hits(docs, bench, keep={"doc_id": "doc_id"}).collect()}
    assert got == {i: brute_force(text, items) for i, text in enumerate(texts)}
    assert (len(written) > 5) == (block == 60) and not any("text" in c for columns in written for c in columns)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "two three"), (2, "lorem ipsum dolor lorem")], "item_id long, text string")
    got = benchmark_hits(odd, bench, keep={"doc_id": "doc_id"}).collect()
    assert len(got) == 10 and sum(len(r.hit_words) == 2 for r in got) == 4
    assert max(len(r.hit_words) for r in got) == 89_998  # all but the last two words
    assert benchmark_hits(empty, bench, keep={"doc_id": "doc_id"}).count() == 0
    none = benchmark_hits(odd, bench.limit(0), keep={"doc_id": "doc_id"}).collect()
    assert len(none) == 10 and all(r.hit_words == [] and r["items"] == [] for r in none)
