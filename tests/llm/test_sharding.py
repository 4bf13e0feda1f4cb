from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.sharding import best_fit_decreasing, pack_into, shard_documents, size_class
from tests.llm.conftest import ODD_ROWS


def brute_force(sizes, capacity):
    """Best-fit decreasing one group at a time over a plain list."""
    free, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(left, shard) for shard, left in enumerate(free) if left >= size]
        if fits:
            left, shard = min(fits)
        else:
            left, shard = max(capacity, size), len(free)
            free.append(left)
        free[shard] = left - size
        out.append((size, shard))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_packing_of_runs_equals_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 200))]
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    placed = best_fit_decreasing(runs, 60)
    got = [shard for groups, shard in placed for _ in range(groups)]
    want = brute_force(sizes, 60)
    fill = lambda pairs: sorted(sum(s for s, b in pairs if b == shard) for shard in {b for _, b in pairs})
    assert len(set(got)) == len({shard for _, shard in want})
    assert fill(list(zip(sorted(sizes, reverse=True), got))) == fill(want)


def test_a_group_over_an_even_share_stands_alone_and_the_rest_is_even():
    placed = pack_into([(1000, 1), (10, 90)], 10)
    filled = {}
    sizes = [1000] + [10] * 90
    for size, shard in zip(sizes, [b for n, b in placed for _ in range(n)]):
        filled[shard] = filled.get(shard, 0) + size
    assert sorted(filled.values()) == [100] * 9 + [1000]


def test_size_class_rounds_up_by_little(spark):
    df = spark.range(1, 200_000, 37).select("id", size_class(F.col("id")).alias("c"))
    assert df.filter("c < id or c > id * (1 + 1 / 2048)").count() == 0
    assert df.filter("id <= 4096 and c <> id").count() == 0
    assert df.select("c").distinct().count() < 3 * 4096


def test_odd_rows(odd):
    got = shard_documents(odd, shards=3).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in ODD_ROWS
    )
    assert len({r.shard for r in got if r.size == 29}) == 1  # the four equal texts
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_capacity_and_hot_group(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string")
    got = shard_documents(df, capacity=2500).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) == 200 * 20 and sorted(sizes.values())[:-1][-1] <= 2500
    assert len({r.shard for r in got if r.size == 20}) == 1


def test_empty(empty):
    assert shard_documents(empty, shards=4).count() == 0
