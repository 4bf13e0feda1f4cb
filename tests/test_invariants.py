"""Cross-checks the reference made by eye, on sf0.01."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans import questions as q
from tallyframe.sources import testdata as td
from tests.conftest import SF01


def test_bin_counts_sum_to_code_counts(spark):
    binned = q.time_bins(td.event_tickets(spark, SF01))
    by_bin = q.top_codes_by_bin(binned, 3).groupBy("Violation_Code").agg(
        F.sum("Number_of_tickets").alias("n")
    )
    top = q.code_frequency(binned).limit(3)
    got = {r.Violation_Code: r.n for r in by_bin.collect()}
    want = {r.Violation_Code: r.Number_of_tickets for r in top.collect()}
    assert got == want


def test_season_counts_sum_to_year(spark):
    tk = td.order_tickets(spark, SF01, td.ORDERS_YEAR)
    total = q.season_counts(q.seasons(tk)).agg(F.sum("ticket_count").alias("n")).first().n
    assert total == q.rows(tk).first().n == 2279


def test_repair_moves_exactly_the_sentinel_rows(spark):
    tk = td.order_tickets(spark, SF01)
    before = {r.Registration_State: r.Num_Of_Entries for r in q.state_counts(tk).collect()}
    after = {r.Registration_State: r.Num_Of_Entries
             for r in q.state_counts_repaired(tk, td.STATE_SENTINEL).collect()}
    moved = before.pop(td.STATE_SENTINEL)
    assert q.sentinel_rows(tk, td.STATE_SENTINEL).first().Num_Of_Entries == moved == 3020
    # 2-HIGH and 3-MEDIUM tie for the mode; the smaller value wins.
    assert after["2-HIGH"] == before["2-HIGH"] + moved
    assert {k: v for k, v in after.items() if k != "2-HIGH"} == {
        k: v for k, v in before.items() if k != "2-HIGH"}
    assert q.distinct_states(tk).first().n_states - 1 == (
        q.distinct_states_repaired(tk, td.STATE_SENTINEL).first().n_states)


def test_strict_and_reference_bins_differ_only_at_12am(spark):
    tk = td.event_tickets(spark, SF01)
    ref = q.time_bins(tk, "reference").groupBy("Violation_Hour_Bin").count()
    strict = q.time_bins(tk, "strict").groupBy("Violation_Hour_Bin").count()
    r = {x[0]: x[1] for x in ref.collect()}
    s = {x[0]: x[1] for x in strict.collect()}
    twelve_am = (q.parsed_times(tk).filter("Violation_hr = '12' AND Violation_AMPM = 'A'").count())
    raw = td.table(spark, SF01, "events")
    assert twelve_am == raw.filter("hour(ts) = 0 AND event_type <> 'error'").count() > 0
    assert r["Afternoon"] - s["Afternoon"] == twelve_am == s["Late_Night"] - r["Late_Night"]
    assert {k: v for k, v in r.items() if k not in ("Afternoon", "Late_Night")} == {
        k: v for k, v in s.items() if k not in ("Afternoon", "Late_Night")}


def test_missing_times_match_the_missing_mark(spark):
    tk = td.event_tickets(spark, SF01)
    assert q.missing_times(tk).first().n_null == 2014
    assert q.parsed_times(tk).count() == tk.count() - 2014


def test_code_mix_rows_match_one_precinct_queries(spark):
    tk = td.event_tickets(spark, SF01)
    mix = q.top_precincts_code_mix(tk, 3, 5)
    precincts = [r.Issuer_Precinct for r in q.top_issuer_precincts(tk, 3).collect()]
    stacked = []
    for p in precincts:
        stacked += [tuple(r) for r in q.precinct_code_mix(tk, p, 5).collect()]
    got = [(r.Violation_Code, r.Frequency_of_Tickets, r.Issuer_Precinct) for r in mix.collect()]
    assert got == stacked
