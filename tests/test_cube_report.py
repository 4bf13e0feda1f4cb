"""The one-scan count cube gives the same answers as the per-question plans."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyframe.operators import rate_schedule
from tallyframe.plans import questions as q
from tallyframe.plans.report import cube_plan, ticket_report, year_slice
from tallyframe.sources import TICKET_COLUMNS, StageFolder
from tools.plan_checks import plan_text


@pytest.fixture(scope="module")
def tickets(spark):
    rng = np.random.default_rng(7)
    n = 4000

    def pick(values, p=None):
        return list(rng.choice(np.array(values, dtype=object), size=n, p=p))

    start = datetime.date(2016, 11, 1)
    dates = [start + datetime.timedelta(days=int(d)) for d in rng.integers(0, 430, size=n)]
    hours = rng.integers(1, 13, size=n)
    minutes = rng.integers(0, 60, size=n)
    ampm = pick(["A", "P"])
    times = [f"{h:02d}{m:02d}{a}" for h, m, a in zip(hours, minutes, ampm)]
    odd = pick(["keep", "nan", "2A", None, "1230A"], p=[0.9, 0.02, 0.02, 0.04, 0.02])
    times = [t if o == "keep" else o for t, o in zip(times, odd)]
    columns = [
        [10_000_000_000 + i for i in range(n)],
        pick(["NY", "NJ", "PA", "CT", "99", None], p=[0.5, 0.2, 0.1, 0.08, 0.1, 0.02]),
        [None if i % 97 == 0 else d for i, d in enumerate(dates)],
        pick(list(range(0, 41)) + [None]),
        pick(["SUBN", "4DSD", "VAN", "DELV", None]),
        pick(["FORD", "TOYOT", "HONDA", "NISSA", "CHEVR", "ME/BE", None]),
        pick(list(range(0, 13)) + [None]),
        pick([7] * 7 + list(range(0, 13)) + [None]),
        times,
    ]
    schema = T.StructType([T.StructField(c, t, True) for c, t in TICKET_COLUMNS.items()])
    rows = [tuple(None if v is None else (int(v) if isinstance(v, (int, np.integer)) else v) for v in r)
            for r in zip(*columns)]
    return spark.createDataFrame(rows, schema).repartition(5)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _direct(tickets, midnight="reference", precinct=None):
    """The aggregate answers by the per-question plans."""
    t = year_slice(tickets, 2017)
    repaired = q.repaired(t, "99")
    binned, seasoned, schedule = q.time_bins(repaired, midnight), q.seasons(repaired), rate_schedule(t.sparkSession)
    one = q.busiest_precinct_code_mix(repaired, 5) if precinct is None else q.precinct_code_mix(repaired, precinct, 5)
    return {
        "q02_rows_in_year": q.rows(t),
        "q03_distinct_states": q.distinct_states(t),
        "q04_state_counts": q.state_counts(t),
        "q05_sentinel_rows": q.sentinel_rows(t, "99"),
        "q06_distinct_states_repaired": q.distinct_states_repaired(t, "99"),
        "q07_state_counts_repaired": q.state_counts_repaired(t, "99"),
        "q08_top_codes": q.top_codes(repaired, 5),
        "q09_top_makes": q.top_makes(repaired, 5),
        "q10_top_body_types": q.top_body_types(repaired, 5),
        "q11_top_violation_precincts": q.top_violation_precincts(repaired, 6),
        "q12_top_issuer_precincts": q.top_issuer_precincts(repaired, 5),
        "q13_precinct_code_mix": one,
        "q14_top_precincts_code_mix": q.top_precincts_code_mix(repaired, 3, 5),
        "q15_missing_times": q.missing_times(repaired),
        "q18_code_frequency": q.code_frequency(binned),
        "q19_top_codes_by_bin": q.top_codes_by_bin(binned, 3),
        "q22_season_counts": q.season_counts(seasoned),
        "q23_season_top_codes": q.season_top_codes(seasoned, 3),
        "q24_top_codes_overall": q.top_code_counts(repaired, 3),
        "q26_zone_a_fines": q.zone_fine_totals(repaired, schedule, "a", 3),
        "q27_zone_b_fines": q.zone_fine_totals(repaired, schedule, "b", 3),
        "q28_code_frequency_top3": q.top_code_counts(repaired, 3),
        "q29_top_code_revenue": q.top_code_revenue(repaired, schedule, 3),
        "e1_bin_top_codes": q.bin_top_codes(binned, 3),
        "e2_top_codes_peak_bin": q.top_codes_peak_bin(binned, 3),
        "e3_codes_across_precincts": q.codes_across_precincts(repaired, 3, 5),
        "e4_precinct_code_lift": q.precinct_code_lift(repaired, 3),
        "e5_top_revenue_code": q.top_revenue_code(repaired, schedule, 3),
    }


def test_cube_answers_equal_per_question_answers(tickets, tmp_path):
    cube = ticket_report(tickets, StageFolder(tickets.sparkSession, str(tmp_path)), year=2017)
    row_level = {"q01_rows_in_file", "q16_parsed_times", "q17_time_bins", "q20_calendar_parts", "q21_seasons"}
    direct = _direct(tickets)
    assert set(cube) - row_level == set(direct)
    for name in sorted(direct):
        assert cube[name].columns == direct[name].columns, name
        assert _rows(cube[name]) == _rows(direct[name]), name


def test_cube_equals_with_literal_precinct_and_strict_midnight(tickets, tmp_path):
    stage = StageFolder(tickets.sparkSession, str(tmp_path))
    cube = ticket_report(tickets, stage, year=2017, precinct=7, midnight="strict")
    direct = _direct(tickets, "strict", 7)
    for name in ("q13_precinct_code_mix", "q15_missing_times", "q19_top_codes_by_bin", "e1_bin_top_codes"):
        assert _rows(cube[name]) == _rows(direct[name]), name


def test_cube_is_one_expand_over_one_scan(tickets, spark, tmp_path):
    path = str(tmp_path / "tickets")
    tickets.write.parquet(path)
    text = plan_text(cube_plan(year_slice(spark.read.parquet(path), 2017)), "simple")
    assert text.count("Expand [") == 1
    assert text.count("FileScan parquet") == 1
    assert text.count("Exchange hashpartitioning") == 1
