"""The whole analysis on a ticket table, in one call.

``ticket_report`` answers every question of the reference on a table with
the ticket columns (``sources.records.TICKET_COLUMNS``), e.g. the result of
``read_records`` on the yearly CSV.  The year slice is written once as
Parquet in a ``StageFolder``, a shared folder that the caller names and that
is deleted afterwards: the answers then read compact, typed, column-pruned
files instead of re-parsing the CSV once per question.

Every aggregate answer comes from one count cube: a single ``GROUPING SETS``
aggregate over the slice (one scan, one ``Expand`` feeding one partial
aggregate, one shuffle) that holds the ticket count of every key of seven
groupings.  The cube is staged too, and the answers are read off it with the
same operators, so the whole report reads the slice once instead of once per
question.  Only the row-level answers (Q16, Q17, Q20, Q21) read the slice
again.  Nothing is collected but the number of source rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyframe.functions.buckets import SEASONS, bucket_intervals, bucket_members
from tallyframe.functions.clock import hour24
from tallyframe.operators.counts import by_measure, distinct_count
from tallyframe.operators.filters import drop_sentinel, in_year, literal_like
from tallyframe.operators.fines import rate_schedule
from tallyframe.operators.lift import spread
from tallyframe.operators.recode import recode_counts
from tallyframe.operators.topk import top_k
from tallyframe.plans import questions as q
from tallyframe.sources.stage import StageFolder

STATE, CODE, ISSUER, BIN, SEASON = q.STATE, q.CODE, q.ISSUER, q.BIN, q.SEASON
MAKE, BODY, VPRECINCT = "Vehicle_Make", "Vehicle_Body_Type", "Violation_Precinct"
# Keys of the count cube, in the order that defines the grouping id bits.
CUBE_KEYS = (STATE, MAKE, BODY, VPRECINCT, ISSUER, CODE, BIN, SEASON)
# The groupings every aggregate answer is read from.
CUBE_SETS: dict[str, tuple[str, ...]] = {
    "state": (STATE,),
    "make": (MAKE,),
    "body": (BODY,),
    "violation_precinct": (VPRECINCT,),
    "precinct_code": (ISSUER, CODE),
    "code_bin": (CODE, BIN),
    "season_code": (SEASON, CODE),
}

SLICE_COLUMNS = (
    "Summons_Number",
    "Registration_State",
    "Issue_Date",
    "Violation_Code",
    "Vehicle_Body_Type",
    "Vehicle_Make",
    "Violation_Precinct",
    "Issuer_Precinct",
    "Violation_Time",
)


def year_slice(tickets: DataFrame, year: int) -> DataFrame:
    """The tickets of one calendar year."""
    return in_year(tickets, "Issue_Date", year).select(*SLICE_COLUMNS)


def stage_year_counting_source(
    tickets: DataFrame, year: int, stage: StageFolder
) -> tuple[DataFrame, DataFrame]:
    """Stage the year slice and count every source row in the same pass.

    The count is an ``Observation`` on the source rows, collected as the
    staging write finishes, so Q01 needs no second read of the source (for
    a CSV, no second parse).  Returns (staged slice, one-row Q01 answer).
    The observation sits between the scan and the year filter, so use it
    for sources the filter cannot prune anyway (CSV, unpartitioned files).
    """
    seen = Observation("tallyframe_source_rows")
    observed = tickets.observe(seen, F.count(F.lit(1)).alias("n"))
    staged = stage.write(year_slice(observed, year), f"tickets-{year}")
    return staged, tickets.sparkSession.createDataFrame([(seen.get["n"],)], "n BIGINT")


def ticket_report(
    tickets: DataFrame,
    stage: StageFolder,
    year: int = 2017,
    state_sentinel: object = "99",
    state_replacement: object = "mode",
    precinct_sentinel: object = 0,
    precinct: object | None = None,
    midnight: str = "reference",
    count_source_while_staging: bool = True,
) -> dict[str, DataFrame]:
    """Every answer of the analysis, keyed by question.

    The answers read the slice and the cube in ``stage``, so write them before
    it is deleted.  ``precinct`` is the single precinct of Q13; by default the
    busiest issuer precinct is used (the reference typed in 19 after reading
    Q12).  ``count_source_while_staging`` counts the source rows (Q01) during
    the staging pass; turn it off for a date-partitioned columnar source, whose
    year filter prunes files, and Q01 then reads the source on its own.
    """
    if count_source_while_staging:
        t, source_rows = stage_year_counting_source(tickets, year, stage)
    else:
        t, source_rows = stage.write(year_slice(tickets, year), f"tickets-{year}"), q.rows(tickets)
    repaired = q.repaired(t, state_sentinel, state_replacement)
    cube = stage.write(cube_plan(t, midnight), "cube")
    answers = cube_answers(t, cube, state_sentinel, state_replacement, precinct_sentinel, precinct)
    answers.update(
        {
            "q01_rows_in_file": source_rows,
            "q16_parsed_times": q.parsed_times(repaired, midnight),
            "q17_time_bins": q.time_bins(repaired, midnight),
            "q20_calendar_parts": q.with_calendar(repaired),
            "q21_seasons": q.seasons(repaired),
        }
    )
    return {name: answers[name] for name in sorted(answers)}


def _set_id(keys: tuple[str, ...]) -> int:
    """``grouping_id()`` of a grouping set: a 1 bit for each key left out."""
    width = len(CUBE_KEYS)
    return sum(1 << (width - 1 - i) for i, key in enumerate(CUBE_KEYS) if key not in keys)


def cube_plan(t: DataFrame, midnight: str = "reference") -> DataFrame:
    """Tickets per key of every grouping in ``CUBE_SETS``, from one pass.

    The time bin is NULL for rows without a time (they are not in the
    binned questions); ``_set`` is the grouping id.
    """
    derived = t.select(
        *CUBE_KEYS[:6],
        F.when(F.col(q.TIME).isNotNull(), bucket_intervals(hour24(q.TIME, midnight))).alias(BIN),
        bucket_members(F.month("Issue_Date"), SEASONS).alias(SEASON),
    )
    return derived.groupingSets([list(keys) for keys in CUBE_SETS.values()], *CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set")
    )


def cube_counts(cube: DataFrame, grouping: str, name: str) -> DataFrame:
    """One grouping of the cube: its keys and the ticket count as ``name``."""
    keys = CUBE_SETS[grouping]
    return cube.filter(F.col("_set") == F.lit(_set_id(keys))).select(*keys, F.col("n").alias(name))


def _count_of_key(counts: DataFrame, key: str, name: str) -> DataFrame:
    """``COUNT(*)`` per key as ``COUNT(key)``: the NULL key counts 0."""
    return counts.withColumn(name, F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.col(name)))


def _summed(counts: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum(measure).alias(name))


def _total(counts: DataFrame, measure: str, name: str) -> DataFrame:
    return counts.agg(F.coalesce(F.sum(measure), F.lit(0)).alias(name))


def cube_answers(
    t: DataFrame,
    cube: DataFrame,
    state_sentinel: object,
    state_replacement: object,
    precinct_sentinel: object,
    precinct: object | None,
) -> dict[str, DataFrame]:
    """Every aggregate answer read off the count cube (same operators as
    the per-question plans, applied to counts instead of facts)."""
    spark = t.sparkSession
    schedule = rate_schedule(spark)
    state = _count_of_key(cube_counts(cube, "state", "Num_Of_Entries"), STATE, "Num_Of_Entries")
    pairs = cube_counts(cube, "precinct_code", "Frequency_of_Tickets")
    codes = _summed(pairs, CODE, "Frequency_of_Tickets", "Frequency_of_Tickets")
    precincts = _summed(pairs, ISSUER, "Frequency_of_Tickets", "Precinct_Issuers")
    code_bins = cube_counts(cube, "code_bin", "Number_of_tickets")
    timed = code_bins.filter(F.col(BIN).isNotNull())
    seasonal = cube_counts(cube, "season_code", "ticket_count")
    repaired = recode_counts(state, STATE, ["Num_Of_Entries"], state_sentinel, state_replacement)

    def top(counts: DataFrame, key: str, name: str, k: int, sentinel: object = None) -> DataFrame:
        src = counts if sentinel is None else drop_sentinel(counts, key, sentinel)
        return top_k(src, name, key, k)

    if precinct is None:
        one = q.mix_of_busiest_precinct(pairs, 5, precinct_sentinel)
    else:
        hit = pairs.filter(F.col(ISSUER) == literal_like(pairs, ISSUER, precinct))
        one = top_k(hit, "Frequency_of_Tickets", [CODE, ISSUER], 5).select(
            CODE, "Frequency_of_Tickets", ISSUER
        )
    mix = q.mix_of_top_precincts(pairs, 3, 5, precinct_sentinel)
    top3 = top_k(codes, "Frequency_of_Tickets", CODE, 3)
    revenues = q.revenue_of_top_codes(top3, schedule)
    code_n = codes.withColumnRenamed("Frequency_of_Tickets", "n")
    return {
        "q02_rows_in_year": _total(pairs, "Frequency_of_Tickets", "n"),
        "q03_distinct_states": distinct_count(state, STATE, "n_states"),
        "q04_state_counts": state.orderBy(*by_measure("Num_Of_Entries", [STATE])),
        "q05_sentinel_rows": _total(
            state.filter(F.col(STATE) == literal_like(state, STATE, state_sentinel)),
            "Num_Of_Entries",
            "Num_Of_Entries",
        ),
        "q06_distinct_states_repaired": distinct_count(repaired, STATE, "n_states"),
        "q07_state_counts_repaired": repaired.orderBy(*by_measure("Num_Of_Entries", [STATE])),
        "q08_top_codes": top(
            _count_of_key(codes.withColumnRenamed("Frequency_of_Tickets", "Occur_Of_Violation_Codes"),
                          CODE, "Occur_Of_Violation_Codes"),
            CODE, "Occur_Of_Violation_Codes", 5,
        ),
        "q09_top_makes": top(
            _count_of_key(cube_counts(cube, "make", "Num_Of_Entries"), MAKE, "Num_Of_Entries"),
            MAKE, "Num_Of_Entries", 5,
        ),
        "q10_top_body_types": top(
            _count_of_key(cube_counts(cube, "body", "Num_Of_Entries"), BODY, "Num_Of_Entries"),
            BODY, "Num_Of_Entries", 5,
        ),
        "q11_top_violation_precincts": top(
            cube_counts(cube, "violation_precinct", "No_Of_Violations"),
            VPRECINCT, "No_Of_Violations", 6, precinct_sentinel,
        ),
        "q12_top_issuer_precincts": top(precincts, ISSUER, "Precinct_Issuers", 5, precinct_sentinel),
        "q13_precinct_code_mix": one,
        "q14_top_precincts_code_mix": mix,
        "q15_missing_times": _total(code_bins.filter(F.col(BIN).isNull()), "Number_of_tickets", "n_null"),
        "q18_code_frequency": _summed(timed, CODE, "Number_of_tickets", "Number_of_tickets").orderBy(
            *by_measure("Number_of_tickets", [CODE])
        ),
        "q19_top_codes_by_bin": q.bins_of_top_codes(timed, 3),
        "q22_season_counts": _summed(seasonal, SEASON, "ticket_count", "ticket_count").orderBy(
            *by_measure("ticket_count", [SEASON])
        ),
        "q23_season_top_codes": q.top_codes_per_season(seasonal, 3),
        "q24_top_codes_overall": top3,
        "q26_zone_a_fines": q.zone_fines_from_counts(code_n, schedule, "a", 3),
        "q27_zone_b_fines": q.zone_fines_from_counts(code_n, schedule, "b", 3),
        "q28_code_frequency_top3": top3,
        "q29_top_code_revenue": revenues,
        "e1_bin_top_codes": q.top_codes_per_bin(timed, 3),
        "e2_top_codes_peak_bin": q.peak_bins(q.bins_of_top_codes(timed, 3, order=False)),
        "e3_codes_across_precincts": spread(mix, CODE, ISSUER, "n_precincts"),
        "e4_precinct_code_lift": q.lift_of_top_precincts(pairs, 3, precinct_sentinel),
        "e5_top_revenue_code": q.best_revenue(revenues),
    }
