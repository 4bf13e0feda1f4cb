from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

import tallyframe.llm.lm_scoring as lm
from tallyframe.llm.decontam import folded
from tallyframe.llm.lm_scoring import PRIOR, STEP, scored


def brute_force(docs, good, size, buckets):
    words = {i: folded(text) for i, (_, text) in enumerate(docs)}
    total = Counter(w for ws in words.values() for w in ws)
    vocabulary = {w: i for i, (w, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size], 1)}
    start = len(vocabulary) + 1
    grams = {}
    for i, ws in words.items():
        ids = [vocabulary.get(w, 0) for w in ws]
        grams[i] = list(zip([start, *ids[:-1]], ids)) if ids else []
    losses = []
    for chosen in (lambda i: docs[i][0] in good, lambda i: True):
        single, before, pairs = Counter(), Counter(), Counter()
        for i, gs in grams.items():
            if chosen(i):
                single.update(b for _, b in gs)
                before.update(a for a, _ in gs)
                pairs.update((a * STEP + b) % buckets for a, b in gs)
        all_ = sum(single.values()) + start

        def loss(a, b):
            p = min(pairs[(a * STEP + b) % buckets], before[a])
            return -math.log((p + PRIOR * (single[b] + 1) / all_) / (before[a] + PRIOR))

        losses.append({i: sum(loss(*g) for g in gs) / len(gs) if gs else 0.0 for i, gs in grams.items()})
    return [(docs[i][0], len(gs), losses[0][i], losses[1][i]) for i, gs in grams.items()]


def compared(spark, docs, good):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in good], "doc_id long")
    got = sorted(map(tuple, scored(frame, ids).drop("score").collect()))
    want = sorted(brute_force(docs, set(good), 1 << 30, 1 << 62))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))


def test_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    good = [i for i in range(40) if i % 3 == 0]
    compared(spark, docs, [*good, *good])
    monkeypatch.setattr(lm, "BROADCAST_IDS", 0)
    compared(spark, docs, good)
    compared(spark, docs, [])


def test_singletons_and_a_target_singleton(spark):
    docs = [(i, " ".join(f"w{100 * i + k}" for k in range(30))) for i in range(20)] + [(50, "w1 w2 w2 w1"), (51, "")]
    compared(spark, docs, [3, 50, 51])


def test_scores_do_not_depend_on_blocks_or_parts(spark):
    """Blocks of few tokens, answered by few or many parts, as by hand."""
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(0, 30)) % 50)) for i in range(60)]
    good = {i for i in range(60) if i % 4 == 0}
    want = sorted(brute_force(docs, good, 1 << 30, 1 << 62))
    schema = lm.to_arrow_schema(lm.block_schema(lm.T.LongType()))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("t", pa.float64()), ("b", pa.float64())])
    for parts, size in ((1, 60), (3, 7), (97, 1)):
        rows = []
        for number, at in enumerate(range(0, 60, size)):
            block = lm.Block()
            for i, text in docs[at : at + size]:
                block.add(i, folded(text), int(i in good))
            rows += block.rows(number, parts)
        groups = {}
        for row in rows:
            groups.setdefault((row["kind"], row["part"]), []).append(row)
        answers = [r for g in groups.values() for r in lm.answered(pa.Table.from_batches([lm.batch_of(g, schema)])).to_pylist()]
        totals = [sum(r[c] for r in answers if r["kind"] == lm.TOTAL) for c in ("v", "n", "target")]
        got = []
        for number in range(-(-60 // size)):
            mine = [r for r in answers if r["block"] == number and r["kind"] != lm.TOTAL]
            found = lm.losses(pa.Table.from_batches([lm.batch_of(mine, schema)]), *totals, out)
            got += [tuple(r.values()) for r in found.to_pylist()]
        assert [g[:2] for g in sorted(got)] == [w[:2] for w in want]
        assert all(abs(a - b) < 1e-9 for g, w in zip(sorted(got), want) for a, b in zip(g[2:], w[2:]))


def test_packing_is_a_round_trip():
    for size in (0, 1, 1000):
        arrays = [np.arange(size, dtype="u8") << np.uint64(40), np.arange(size, dtype="i4") - 5, np.arange(size, dtype="i8") * -7]
        for a, b in zip(arrays, lm.unpacked(lm.packed(*arrays), size, "u8", "i4", "i8")):
            assert a.dtype == b.dtype and (a == b).all()


def test_all_words_and_bigrams_count_exactly(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 70_000}" for _ in range(100))) for i in range(300)]
    docs += [(1000, ""), (1001, None), (1002, " "), (3, "w1 w1 w2")]
    good = [i for i in range(300) if i % 3 == 0]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = scored(frame, spark.createDataFrame([(i,) for i in good], "doc_id long")).drop("score").collect()
    got, want = sorted(map(tuple, got)), sorted(brute_force(docs, set(good), len(docs) * 100, 1 << 62))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))


def test_text_like_the_target_scores_lower(spark):
    docs = [(i, "clear prose about rivers and hills") for i in range(20)] + [(100 + i, "buy cheap pills now now") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in scored(frame, frame.filter("doc_id < 20").select("doc_id")).collect()}
    assert max(got[i] for i in range(20)) < 0 < min(got[100 + i] for i in range(20))


def test_odd_rows(spark, odd, empty):
    ids = spark.createDataFrame([(3,), (None,)], "doc_id long")
    got = scored(odd, ids).collect()
    assert len(got) == 10 and all(math.isfinite(r.score) for r in got)
    assert {(r.n_tokens, r.score) for r in got if r.doc_id in (1, 2, 5)} == {(0, 0.0)}
    assert scored(empty, ids).count() == 0
