"""Counts, distinct counts and top-k: NULL groups, ties, the k cut."""

from __future__ import annotations

import pytest

from tallyframe.operators import (
    crosstab_counts,
    distinct_count,
    row_count,
    top_k,
    top_k_per_group,
    value_counts,
)
from tallyframe.operators.topk import counted_top_k_per_group, rows_of_top_groups, top_groups


@pytest.fixture(scope="module")
def states(spark):
    data = [("NY",)] * 4 + [("NJ",)] * 2 + [("PA",)] * 2 + [(None,)] * 3 + [("99",)]
    return spark.createDataFrame(data, "s string")


def test_count_col_null_group_is_zero(states):
    got = dict((r.s, r.n) for r in value_counts(states, "s", "n", count_col="s").collect())
    assert got == {"NY": 4, "NJ": 2, "PA": 2, None: 0, "99": 1}


def test_count_star_counts_null_rows(states):
    got = dict((r.s, r.n) for r in value_counts(states, "s", "n").collect())
    assert got[None] == 3


def test_value_counts_order(states):
    got = [r.s for r in value_counts(states, "s", "n").collect()]
    assert got == ["NY", None, "NJ", "PA", "99"]


def test_distinct_count_ignores_null(states):
    assert distinct_count(states, "s", "n").first().n == 4
    assert row_count(states).first().n == 12


def test_top_k_tie_at_cut_goes_to_smaller_key(states):
    counts = value_counts(states, "s", "n", count_col="s", order=False)
    assert [r.s for r in top_k(counts, "n", "s", 2).collect()] == ["NY", "NJ"]
    with pytest.raises(ValueError):
        top_k(counts, "n", "s", 0)


@pytest.fixture(scope="module")
def pairs(spark):
    # group g1: a=5, b=3, c=3, d=3, e=1 (three-way tie at dense rank 2)
    # group g2: x=2 (fewer than k items)
    data = [("g1", "a", 5), ("g1", "b", 3), ("g1", "c", 3), ("g1", "d", 3), ("g1", "e", 1),
            ("g2", "x", 2)]
    return spark.createDataFrame(data, "g string, i string, n long")


def test_dense_rank_keeps_ties(pairs):
    got = [(r.g, r.i) for r in top_k_per_group(pairs, "g", "i", "n", 2, ties="dense").collect()]
    assert got == [("g1", "a"), ("g1", "b"), ("g1", "c"), ("g1", "d"), ("g2", "x")]


def test_rank_and_row_number(pairs):
    got = [(r.g, r.i) for r in top_k_per_group(pairs, "g", "i", "n", 2, ties="rank").collect()]
    assert got == [("g1", "a"), ("g1", "b"), ("g1", "c"), ("g1", "d"), ("g2", "x")]
    got = [(r.g, r.i) for r in top_k_per_group(pairs, "g", "i", "n", 2, ties="row").collect()]
    assert got == [("g1", "a"), ("g1", "b"), ("g2", "x")]
    got = top_k_per_group(pairs, "g", "i", "n", 3, ties="rank", rank_col="rk").collect()
    assert [(r.i, r.rk) for r in got if r.g == "g1"] == [("a", 1), ("b", 2), ("c", 2), ("d", 2)]


def test_top_k_per_group_checks(pairs):
    with pytest.raises(ValueError):
        top_k_per_group(pairs, "g", "i", "n", 2, ties="first")


def test_counted_top_k_per_group(spark):
    facts = spark.createDataFrame(
        [("w", 1)] * 3 + [("w", 2)] * 2 + [("w", 3)] * 2 + [("s", 9)], "season string, code int"
    )
    got = [tuple(r) for r in counted_top_k_per_group(facts, "season", "code", 1).collect()]
    assert got == [("s", 9, 1), ("w", 1, 3)]


def test_top_groups_and_rows_of_top_groups(pairs, spark):
    more = pairs.unionByName(spark.createDataFrame([("g3", "y", 15), ("0", "z", 99)], pairs.schema))
    top = [(r.g, r.t) for r in top_groups(more, "g", "n", 2, "t", sentinel="0").collect()]
    assert top == [("g1", 15), ("g3", 15)]
    kept = rows_of_top_groups(more, "g", "n", 2, "t", sentinel="0")
    assert sorted((r.g, r.i) for r in kept.collect()) == [
        ("g1", "a"), ("g1", "b"), ("g1", "c"), ("g1", "d"), ("g1", "e"), ("g3", "y")]


def test_crosstab_counts_only(spark):
    facts = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "x"), (3, "z")], "c int, b string")
    only = spark.createDataFrame([(1,), (3,)], "c int")
    got = [tuple(r) for r in crosstab_counts(facts, "c", "b", "n", only=only).collect()]
    assert got == [(1, "x", 2), (1, "y", 1), (3, "z", 1)]


def test_null_profile(states):
    from tallyframe.operators import not_null_rows, null_rows, profile_nulls

    assert null_rows(states, "s").count() == 3
    assert not_null_rows(states, "s").count() == 9
    assert profile_nulls(states, ["s"]).first().n_null_s == 3


def test_top_k_per_group_two_group_columns(spark):
    data = [("2017", "W", 1, 5), ("2017", "W", 2, 3), ("2017", "S", 1, 1), ("2016", "W", 9, 2), ("2016", "W", 8, 2)]
    df = spark.createDataFrame(data, "y string, s string, code int, n long")
    got = [tuple(r) for r in top_k_per_group(df, ["y", "s"], "code", "n", 1, ties="row").collect()]
    assert got == [("2016", "W", 8, 2), ("2017", "S", 1, 1), ("2017", "W", 1, 5)]
