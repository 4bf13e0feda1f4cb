from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tallyframe.llm.simhash import (
    band_masks,
    components,
    fingerprint,
    fingerprint_edges,
    local_components,
    near_duplicates,
    plan_bands,
)
from tests.llm.conftest import ODD_ROWS


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints, radius):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def cluster(n, seed=3):
    rng = random.Random(seed)
    base, out = rng.getrandbits(64), set()
    while len(out) < n:
        value = base if rng.random() < 0.7 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            value ^= 1 << bit
        out.add(value)
    return np.array(sorted(out), "u8")


@pytest.mark.parametrize("text", ["", None, "a b c", "A B C D", "a b c d e f a b c d", "x " * 70_000, "Ünï b\x0bc d\x1ce"])
def test_fingerprint(text):
    assert fingerprint(text) & (2**64 - 1) == brute_print(text)


@pytest.mark.parametrize("distinct, radius", [(10, 4), (50_000, 4), (10**7, 4), (10**9, 4), (10**12, 4), (10**6, 2), (10**6, 0)])
def test_every_pair_within_the_radius_shares_a_key(distinct, radius):
    masks = band_masks(*plan_bands(distinct, radius))
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any((flips & (mask & (2**64 - 1))) == 0 for mask in masks)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_comparison_matches_brute_force(radius):
    prints = cluster(700)
    rng = random.Random(8)
    order = np.array(rng.sample(range(700), 700))
    prints = prints[order]
    assert local_components(np.zeros(700), prints, radius).tolist() == brute_labels(prints, radius)
    # buckets: only rows of one bucket are linked
    buckets = np.sort(np.array([rng.randint(0, 9) for _ in range(700)]))
    got = local_components(buckets, prints, radius)
    for bucket in range(10):
        rows = np.flatnonzero(buckets == bucket)
        assert got[rows].tolist() == [rows[i] for i in brute_labels(prints[rows], radius)]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_buckets_cut_by_partitions_lose_no_link(spark, partitions):
    prints = cluster(900)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(int(p),) for p in prints.view("i8")], "fp long")
        got = {r.a: r.b for r in components(fingerprint_edges(frame, 4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    labels = brute_labels(prints, 4)
    assert len(got) == sum(label != i for i, label in enumerate(labels))
    ids = prints.view("i8").tolist()
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, set()).add(got.get(ids[i], ids[i]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5)]
    rng = random.Random(0)
    rng.shuffle(chain)
    got = {r.a: r.b for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base, base.replace("w7 ", "W7 "), base.replace("w299", "x"), "other text of its own here", None, ""]
    df = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    prints = np.array([brute_print(t) for t in texts], "u8")
    assert got == {10 + i: 10 + label for i, label in enumerate(brute_labels(prints, 4))}
    assert got[11] == got[12] == got[13] == 10 and got[16] == got[15] == 15


def test_odd_rows(odd, empty):
    got = near_duplicates(odd).collect()
    assert len(got) == len(ODD_ROWS)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 5)} == {1}
    assert {r.component_id for r in got if r.fp == fingerprint("one two three") & -1 or r.doc_id == 3} == {3}
    alone = near_duplicates(odd.filter("doc_id is null")).collect()
    assert len(alone) == 2 and {r.component_id for r in alone} == {None}
    assert near_duplicates(empty).count() == 0
