"""Placeholder repair (mode rule, K13) and the fine schedule (K9, K10)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import (
    RATE_A,
    RATE_B,
    fine_totals,
    mode_of,
    rate_schedule,
    recode_sentinel,
    revenue,
    schedule_means,
)
from tallyframe.operators.recode import recode_counts


def _states(spark, data):
    return spark.createDataFrame([(s,) for s in data], "s string")


def test_mode_skips_sentinel_that_is_the_mode(spark):
    df = _states(spark, ["99"] * 5 + ["NY"] * 3 + ["NJ"] * 2 + [None] * 9)
    assert mode_of(df, "s", exclude=["99"]).first().s == "NY"


def test_mode_tie_goes_to_smallest(spark):
    df = _states(spark, ["99"] * 5 + ["NY"] * 3 + ["NJ"] * 3)
    assert mode_of(df, "s", exclude=[99]).first().s == "NJ"


def test_recode_moves_exactly_sentinel_rows(spark):
    df = _states(spark, ["99"] * 5 + ["NY"] * 3 + ["NJ"] * 2 + [None])
    out = recode_sentinel(df, "s", 99)  # a number against a string column (K3)
    got = dict((r.s, r["count"]) for r in out.groupBy("s").count().collect())
    assert got == {"NY": 8, "NJ": 2, None: 1}


def test_recode_literal(spark):
    df = _states(spark, ["99", "NJ", None])
    got = sorted((r.s or "") for r in recode_sentinel(df, "s", "99", "NY").collect())
    assert got == ["", "NJ", "NY"]


def test_recode_counts_equals_recode_then_count(spark):
    df = _states(spark, ["99"] * 7 + ["NY"] * 3 + ["NJ"] * 3 + ["PA"] + [None] * 2)
    direct = dict(
        (r.s, r.n) for r in recode_sentinel(df, "s", "99").groupBy("s").agg(F.count("s").alias("n")).collect()
    )
    counts = df.groupBy("s").agg(F.count("s").alias("n"))
    via_counts = dict((r.s, r.n) for r in recode_counts(counts, "s", ["n"], "99").collect())
    assert direct == via_counts == {"NJ": 10, "NY": 3, "PA": 1, None: 0}


def test_schedule_shape_and_means(spark):
    schedule = rate_schedule(spark)
    assert schedule.count() == 99 == len(RATE_A) == len(RATE_B)
    m = schedule_means(schedule).first()
    assert (m.n_rate_a, m.n_rate_b) == (89, 88)
    assert m.mean_rate_a == pytest.approx(112.808989, abs=1e-6)
    assert m.mean_rate_b == pytest.approx(109.090909, abs=1e-6)
    got = {r.Violation_Code: (r.rate_a, r.rate_b) for r in schedule.collect()}
    assert got[21] == (65, 45) and got[36] == (50, 50) and got[38] == (65, 35)
    assert got[4] == (115, None)
    for code in (15, 33, 34, 41, 43, 76, 87, 88, 90, 95):
        assert got[code] == (None, None)


def test_revenue_uses_the_schedule_for_38(spark):
    schedule = rate_schedule(spark)
    top = spark.createDataFrame(
        [(21, 768087), (36, 662765), (38, 542079), (0, 5)], "Violation_Code int, Frequency_of_Tickets long"
    )
    got = {r.Violation_Code: (r.Average_Fine_PerTicket, r.Total_Fine_Amount)
           for r in revenue(top, schedule).collect()}
    assert got[21] == (55.0, 42244785.0)
    assert got[36] == (50.0, 33138250.0)
    assert got[38] == (50.0, 27103950.0)  # the reference typed (65+65)/2
    assert got[0] == (None, None)          # no such code in the schedule


def test_fine_totals_reference_lines(spark):
    schedule = rate_schedule(spark)
    counts = spark.createDataFrame(
        [(21, 768087), (36, 662765), (38, 542079), (14, 476664)], "Violation_Code int, n long"
    )
    codes = counts.filter("Violation_Code IN (21, 36, 38)")
    a = {r.Violation_Code: r.Violation_Fine_Sum
         for r in fine_totals(counts, schedule, "a", codes=codes).collect()}
    assert a == {21: 49925655, 36: 33138250, 38: 35235135, 14: None}
    b = {r.Violation_Code: r.Violation_Fine_Sum
         for r in fine_totals(counts, schedule, "b", codes=codes).collect()}
    assert b == {21: 34563915, 36: 33138250, 38: 18972765, 14: None}
    with pytest.raises(ValueError):
        fine_totals(counts, schedule, "c")
