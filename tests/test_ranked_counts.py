"""Top-k per group by a threshold algorithm over stored partial counts."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe.operators.topk import counted_top_k_per_group
from tallyframe.sources import StageFolder
from tallyframe.sources.ranked import RankedCounts

SCHEMA = "part int, g string, i long"


def stored(spark, path, df):
    counts = RankedCounts(spark, str(path / "ranked"), "part", "g", "i")
    counts.deliver_all(df)
    return counts


def both(spark, path, counts, df, k, ties):
    with StageFolder(spark, str(path / "stage")) as stage:
        got = [tuple(r) for r in counts.top_k(k, stage, ties=ties).collect()]
    return got, [tuple(r) for r in counted_top_k_per_group(df, "g", "i", k, ties=ties).collect()]


def skewed(spark):
    """Groups of very different size; each part ranks the items a little differently."""
    rng = np.random.default_rng(5)
    rows = []
    for part in range(4):
        for g, size in (("a", 12_000), ("b", 3_000), (None, 600), ("d", 40)):
            items = (rng.zipf(1.4, size) % 100_003).tolist()
            rows += [(part, g, None if i == 2 else i) for i in items]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("ties", ["dense", "rank", "row"])
def test_equal_to_the_window_over_all_rows(spark, tmp_path, ties):
    df = skewed(spark).cache()
    counts = stored(spark, tmp_path, df)
    for k in (1, 4):
        got, want = both(spark, tmp_path, counts, df, k, ties)
        assert got == want and {g for g, *_ in got} == {None, "a", "b", "d"}


def rows_scanned(df, monkeypatch):
    """Rows that each filter on the stored lists lets through, as ``top_k`` asks for them."""
    asked, whole = [], RankedCounts.read
    plain = type(df).filter

    def read(self):
        lists = whole(self)

        def watched(condition):
            rows = plain(lists, condition)
            asked.append(rows)
            return rows

        lists.filter = watched
        return lists

    monkeypatch.setattr(RankedCounts, "read", read)
    return asked


def test_a_proven_cut_reads_a_small_share(spark, tmp_path, monkeypatch):
    df = skewed(spark).filter("g IN ('a', 'b')").cache()
    counts = stored(spark, tmp_path, df)
    whole = counts.read().count()
    asked = rows_scanned(df, monkeypatch)
    with StageFolder(spark, str(tmp_path / "stage")) as stage:
        got = [tuple(r) for r in counts.top_k(3, stage).collect()]
    assert got == [tuple(r) for r in counted_top_k_per_group(df, "g", "i", 3).collect()]
    assert 0 < sum(rows.count() for rows in asked) < whole / 10
    plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(depth" in plan and "PushedFilters: []" in plan


def test_candidates_are_looked_up_only_where_they_were_not_met(spark, tmp_path, monkeypatch):
    """Part 1 is large and names the first items; part 2 is small and hardly knows them."""
    rows = [(1, "a", i) for i in range(400) for _ in range(900 // (i + 1))]
    rows += [(2, "a", 1000 + i) for i in range(20) for _ in range(1 + i % 9)] + [(2, "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = stored(spark, tmp_path, df)
    asked = rows_scanned(df, monkeypatch)
    with StageFolder(spark, str(tmp_path / "stage")) as stage:
        got = [tuple(r) for r in counts.top_k(2, stage).collect()]
    assert got == [("a", 0, 901), ("a", 1, 450)]
    assert [{r.part for r in rows.select("part").distinct().collect()} for rows in asked] == [{1, 2}, {2}]


def test_bounds_that_ties_break_are_counted_in_full(spark, tmp_path):
    """Two items look different above and are equal in total, so a third rank must be found."""
    rows = [(1, "a", i) for i, n in ((1, 40), (2, 37), (3, 9), (4, 1)) for _ in range(n)]
    rows += [(2, "a", i) for i, n in ((5, 16), (2, 4), (1, 1), (3, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = both(spark, tmp_path, stored(spark, tmp_path, df), df, 2, "dense")
    assert got == want == [("a", 1, 41), ("a", 2, 41), ("a", 5, 16)]


def test_an_item_low_in_every_part_wins(spark, tmp_path):
    """Item 9 is second everywhere and first in total; each part has another first one."""
    rows = [(p, "a", i) for p in range(5) for i, n in ((p, 40), (9, 11), (100 + p, 9)) for _ in range(n)]
    rows += [(p, "a", 1000 + 50 * p + i) for p in range(5) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = both(spark, tmp_path, stored(spark, tmp_path, df), df, 1, "row")
    assert got == want == [("a", 9, 55)]


cells = st.tuples(st.integers(0, 2), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 6)), st.integers(1, 20))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(cells, max_size=25), st.integers(1, 3), st.sampled_from(["dense", "rank", "row"]))
def test_any_counts(spark, tmp_path_factory, counts, k, ties):
    path = tmp_path_factory.mktemp("any")
    df = spark.createDataFrame([c[:3] for c in counts for _ in range(c[3])], SCHEMA).coalesce(2)
    got, want = both(spark, path, stored(spark, path, df), df, k, ties)
    assert got == want


def test_a_second_delivery_replaces_the_first(spark, tmp_path):
    first = spark.createDataFrame([(p, "a", i) for p in (1, 2) for i in (1, 1, 1, 1, 1, 2)], SCHEMA)
    counts = stored(spark, tmp_path, first)
    again = spark.createDataFrame([(2, "a", 2), (2, "a", 2), (2, "b", 7)], SCHEMA)
    counts.deliver(again.drop("part"), 2)
    df = first.filter("part = 1").unionAll(again)
    got, want = both(spark, tmp_path, counts, df, 2, "dense")
    assert got == want == [("a", 1, 5), ("a", 2, 3), ("b", 7, 1)]
    reopened = RankedCounts(spark, str(tmp_path / "ranked"), "part", "g", "i")
    assert both(spark, tmp_path, reopened, df, 2, "dense")[0] == want
    counts.deliver(again.drop("part").limit(0), 2)
    assert both(spark, tmp_path, counts, df, 2, "dense")[0] == [("a", 1, 5), ("a", 2, 1)]


def test_empty_table_and_refused_names(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert both(spark, tmp_path, stored(spark, tmp_path, df), df, 2, "row") == ([], [])
    with pytest.raises(ValueError, match="rename"):
        RankedCounts(spark, str(tmp_path), "part", "g", "depth")
    with pytest.raises(ValueError, match="ties"):
        stored(spark, tmp_path, df).top_k(0, None)
