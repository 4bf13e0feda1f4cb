"""Results do not depend on partitioning or row order (guards ties, K6)."""

from __future__ import annotations

from collections import Counter

import duckdb
import pandas as pd
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from tallyframe.operators import top_k, top_k_per_group, value_counts

ROWS = st.lists(
    st.tuples(st.sampled_from(["g1", "g2", "g3"]), st.integers(min_value=0, max_value=6)),
    min_size=1,
    max_size=60,
)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _brute_top_k(data, k):
    counts = Counter(i for _g, i in data)
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]


def _brute_dense(data, k):
    out = set()
    counts = Counter(data)
    for g in {g for g, _ in data}:
        items = {i: n for (gg, i), n in counts.items() if gg == g}
        levels = sorted(set(items.values()), reverse=True)[:k]
        out |= {(g, i, n) for i, n in items.items() if n in levels}
    return out


@SETTINGS
@given(data=ROWS, parts=st.integers(min_value=1, max_value=7))
def test_top_k_independent_of_partitioning(spark, data, parts):
    df = spark.createDataFrame(data, "g string, i int").repartition(parts)
    counts = value_counts(df, "i", "n", order=False)
    got = [(r.i, r.n) for r in top_k(counts, "n", "i", 3).collect()]
    assert got == _brute_top_k(data, 3)


@SETTINGS
@given(data=ROWS, parts=st.integers(min_value=1, max_value=7))
def test_dense_top_k_per_group_matches_brute_force(spark, data, parts):
    df = spark.createDataFrame(data, "g string, i int").repartition(parts)
    counts = value_counts(df, ["g", "i"], "n", order=False)
    got = {tuple(r) for r in top_k_per_group(counts, "g", "i", "n", 2).collect()}
    assert got == _brute_dense(data, 2)


def _brute_top_groups(data, k):
    totals = Counter(g for g, _i in data)
    keep = [g for g, _n in sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
    pairs = Counter(data)
    return {(g, i, n, totals[g]) for (g, i), n in pairs.items() if g in keep}


@SETTINGS
@given(data=ROWS, parts=st.integers(min_value=1, max_value=7), k=st.integers(min_value=1, max_value=3))
def test_rows_of_top_groups_matches_brute_force(spark, data, parts, k):
    from tallyframe.operators import rows_of_top_groups

    df = spark.createDataFrame(data, "g string, i int").repartition(parts)
    counts = value_counts(df, ["g", "i"], "n", order=False)
    got = {tuple(r) for r in rows_of_top_groups(counts, "g", "n", k, "t").collect()}
    assert got == _brute_top_groups(data, k)


STATE_ROWS = st.lists(st.sampled_from(["99", "NY", "NJ", "PA", None]), min_size=1, max_size=40)


@SETTINGS
@given(data=STATE_ROWS)
def test_recode_counts_equals_recoding_rows(spark, data):
    from pyspark.sql import functions as F

    from tallyframe.operators import recode_counts, recode_sentinel

    df = spark.createDataFrame([(s,) for s in data], "s string")
    direct = {r.s: r.n for r in recode_sentinel(df, "s", "99").groupBy("s").agg(F.count("s").alias("n")).collect()}
    counts = df.groupBy("s").agg(F.count("s").alias("n"))
    assert {r.s: r.n for r in recode_counts(counts, "s", ["n"], "99").collect()} == direct
    valid = Counter(s for s in data if s not in (None, "99"))
    if valid:
        mode = sorted(valid.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        want = dict(valid)
        want[mode] += data.count("99")
        assert {s: n for s, n in direct.items() if s is not None} == want


CODES = st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=80)


@SETTINGS
@given(codes=CODES, zone=st.sampled_from(["a", "b"]))
def test_fine_totals_equal_row_level_case_sum(spark, codes, zone):
    from tallyframe.operators import fine_totals, rate_schedule
    from tallyframe.operators.fines import RATE_A, RATE_B

    rates = dict(zip(range(1, 100), RATE_A if zone == "a" else RATE_B))
    counts_by_code = Counter(codes)
    top = sorted(counts_by_code.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    chosen = {c for c, _n in top}
    # SUM(CASE WHEN code IN chosen THEN rate END) per code, row by row
    want = {}
    for c in counts_by_code:
        parts = [rates.get(c) for _ in range(counts_by_code[c])] if c in chosen else []
        vals = [v for v in parts if v is not None]
        want[c] = sum(vals) if vals else None
    schedule = rate_schedule(spark)
    counts = spark.createDataFrame(list(counts_by_code.items()), "Violation_Code int, n long")
    chosen_df = spark.createDataFrame([(c,) for c in chosen], "Violation_Code int")
    got = {r.Violation_Code: r.Violation_Fine_Sum
           for r in fine_totals(counts, schedule, zone, codes=chosen_df).collect()}
    assert got == want


def _python_rule(text, midnight):
    """The clock rule stated in plain Python (None = NULL)."""
    if text is None:
        return None, "Night"
    hour_txt, ampm = text[0:2], text[4:5]
    digits = hour_txt.strip(" ")  # Spark's string-to-int cast trims surrounding spaces
    hr = int(digits) if digits.isdigit() else None
    if hr is None:
        h = None
    elif hr != 12 and ampm == "P":
        h = hr + 12
    elif midnight == "strict" and hr == 12 and ampm == "A":
        h = 0
    else:
        h = hr
    label = "Night"
    for name, lo, hi in (("Late_Night", 0, 3), ("Early_Morning", 4, 7), ("Morning", 8, 11),
                         ("Afternoon", 12, 15), ("Evening", 16, 19)):
        if h is not None and lo <= h <= hi:
            label = name
            break
    return h, label


TIMES = st.one_of(
    st.builds(lambda h, m, a: f"{h:02d}{m:02d}{a}", st.integers(0, 13), st.integers(0, 59), st.sampled_from("AP")),
    st.text(alphabet="0123456789APx ", min_size=0, max_size=6),
    st.none(),
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(times=st.lists(TIMES, min_size=1, max_size=30), midnight=st.sampled_from(["reference", "strict"]))
@example(times=[" 8 0P", "1 00A", "  ", "12 0A", "1230A", "1330P", "nan", "2A", "", None], midnight="reference")
@example(times=[" 8 0P", "1 00A", "  ", "12 0A", "1230A", "1330P", "nan", "2A", "", None], midnight="strict")
def test_clock_rule_matches_plain_python(spark, times, midnight):
    from tallyframe.functions import bucket_intervals, hour24

    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string")
    got = [(r.h, r.b) for r in df.select(
        "i", hour24("t", midnight).alias("h"), bucket_intervals(hour24("t", midnight)).alias("b")
    ).orderBy("i").collect()]
    assert got == [_python_rule(t, midnight) for t in times]


NULL_ROWS = st.lists(
    st.tuples(st.sampled_from(["g1", "g2", None]), st.sampled_from([1, 2, 3, None])), min_size=1, max_size=50
)


@SETTINGS
@given(data=NULL_ROWS, k=st.integers(min_value=1, max_value=3), sentinel=st.sampled_from([None, "g1"]))
@example(data=[(None, 1)] * 4 + [("g1", None)] * 3 + [("g2", 1)], k=2, sentinel=None)
@example(data=[(None, 1)] * 4 + [("g1", None)] * 3 + [("g2", 1)], k=2, sentinel="g1")
def test_null_groups_and_items_follow_one_rule(spark, data, k, sentinel):
    """Top groups and lift against DuckDB: a NULL key is a group like any other,
    and a sentinel leaves out itself and NULL."""
    from tallyframe.operators import rows_of_top_groups, share_lift, top_groups

    duck = duckdb.connect()
    frame = pd.DataFrame(data, columns=["g", "i"]).astype({"g": object, "i": "Int64"})
    duck.register("facts", frame)
    real = "" if sentinel is None else f"WHERE g <> '{sentinel}'"
    kept = f"""pairs AS (SELECT g, i, count(*) AS n FROM facts GROUP BY ALL),
        top AS (SELECT g, sum(n) AS t FROM pairs {real} GROUP BY g ORDER BY t DESC, g NULLS FIRST LIMIT {k})"""
    counts = value_counts(spark.createDataFrame(data, "g string, i int"), ["g", "i"], "n", order=False)
    got = {tuple(r) for r in rows_of_top_groups(counts, "g", "n", k, "t", sentinel).collect()}
    assert got == set(duck.sql(f"WITH {kept} SELECT p.g, i, n, t FROM pairs p JOIN top ON p.g IS NOT DISTINCT FROM top.g").fetchall())
    top = top_groups(counts, "g", "n", k, "t", sentinel)
    lift = {(r.g, r.i): (r.share_in_group, r.share_overall) for r in share_lift(counts, "g", "i", "n", top).collect()}
    want = duck.sql(f"""WITH {kept} SELECT p.g, i, n / sum(n) OVER (PARTITION BY p.g),
        (SELECT sum(n) FROM pairs o WHERE o.i IS NOT DISTINCT FROM p.i) / (SELECT sum(n) FROM pairs)
        FROM pairs p JOIN top ON p.g IS NOT DISTINCT FROM top.g""").fetchall()
    assert lift == {(g, i): (a, b) for g, i, a, b in want}
