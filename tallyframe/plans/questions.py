"""The analysis' questions over a ticket table, built from the operators.

Each function takes ticket DataFrames (columns named as in
``sources.records.TICKET_COLUMNS``) and returns a lazy DataFrame whose
column names match the reference's result tables.  No job runs while it is built.  Nothing is collected:
values the reference read off the screen and typed back in (top precincts,
top codes, the modal state) are computed and joined, so every answer stays
one Spark plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.buckets import SEASONS, TIME_OF_DAY_BINS, TIME_OF_DAY_DEFAULT
from tallyframe.functions.buckets import bucket_intervals, bucket_members
from tallyframe.functions.calendar import calendar_parts
from tallyframe.functions.clock import clock_parts
from tallyframe.operators.counts import count_of, distinct_count, row_count, value_counts
from tallyframe.operators.filters import (
    drop_sentinel,
    in_year,
    not_null_rows,
    null_count,
    only_value,
)
from tallyframe.operators.fines import fine_totals, revenue
from tallyframe.operators.lift import share_lift, spread
from tallyframe.operators.recode import recode_counts, recode_sentinel
from tallyframe.operators.topk import (
    counted_top_k_per_group,
    rows_of_top_groups,
    top_groups,
    top_k,
    top_k_per_group,
)

STATE = "Registration_State"
CODE = "Violation_Code"
ISSUER = "Issuer_Precinct"
TIME = "Violation_Time"
BIN = "Violation_Hour_Bin"
SEASON = "Seasonality"


# -- examine the data ----------------------------------------------------

def rows(tickets: DataFrame) -> DataFrame:
    """Q01: rows in the table."""
    return row_count(tickets, "n")


def rows_in_year(tickets: DataFrame, year: int, date_col: str = "Issue_Date") -> DataFrame:
    """Q02: rows in one calendar year."""
    return row_count(in_year(tickets, date_col, year), "n")


def distinct_states(tickets: DataFrame) -> DataFrame:
    """Q03: number of distinct registration states."""
    return distinct_count(tickets, STATE, "n_states")


def state_counts(tickets: DataFrame) -> DataFrame:
    """Q04 / Q07: tickets per state (``COUNT(state)``, so a NULL state shows 0)."""
    return value_counts(tickets, STATE, "Num_Of_Entries", count_col=STATE)


def sentinel_rows(tickets: DataFrame, sentinel: object) -> DataFrame:
    """Q05: rows whose state is the placeholder."""
    hit = only_value(tickets, STATE, sentinel)
    return hit.agg(F.count(F.col(STATE)).alias("Num_Of_Entries"))


def repaired(tickets: DataFrame, sentinel: object, replacement: object = "mode") -> DataFrame:
    """The table with the placeholder state replaced (by the mode by default)."""
    return recode_sentinel(tickets, STATE, sentinel, replacement)


def repaired_state_counts(
    tickets: DataFrame, sentinel: object, replacement: object = "mode"
) -> DataFrame:
    """Per-state ``COUNT(state)`` after the repair, from one pass over the facts:
    the mode and the re-keyed counts share the exchange of the per-state counts.
    """
    counts = tickets.groupBy(STATE).agg(F.count(F.col(STATE)).alias("Num_Of_Entries"))
    return recode_counts(counts, STATE, ["Num_Of_Entries"], sentinel, replacement)


def distinct_states_repaired(tickets: DataFrame, sentinel: object, replacement: object = "mode") -> DataFrame:
    """Q06: distinct states after the repair, as the states with entries: reading
    the counts keeps the aggregate, whose exchange the mode shares."""
    counts = repaired_state_counts(tickets, sentinel, replacement)
    return counts.agg(F.count_if(F.col("Num_Of_Entries") > 0).alias("n_states"))


def state_counts_repaired(tickets: DataFrame, sentinel: object, replacement: object = "mode") -> DataFrame:
    """Q07: tickets per state after the repair."""
    out = repaired_state_counts(tickets, sentinel, replacement)
    return out.orderBy(F.col("Num_Of_Entries").desc(), F.col(STATE).asc_nulls_first())


# -- frequencies and top-k ------------------------------------------------

def top_values(tickets: DataFrame, col: str, name: str, k: int, sentinel: object = None) -> DataFrame:
    """Top-k values of ``col`` by ``COUNT(col)``; ties by value.

    With ``sentinel`` the rows ``col <> sentinel`` are kept first, which
    also drops NULL rows.
    """
    src = tickets if sentinel is None else drop_sentinel(tickets, col, sentinel)
    counts = value_counts(src, col, name, count_col=col, order=False)
    return top_k(counts, name, col, k)


def top_codes(tickets: DataFrame, k: int = 5) -> DataFrame:
    """Q08: top violation codes."""
    return top_values(tickets, CODE, "Occur_Of_Violation_Codes", k)


def top_makes(tickets: DataFrame, k: int = 5) -> DataFrame:
    """Q09: top vehicle makes."""
    return top_values(tickets, "Vehicle_Make", "Num_Of_Entries", k)


def top_body_types(tickets: DataFrame, k: int = 5) -> DataFrame:
    """Q10: top vehicle body types."""
    return top_values(tickets, "Vehicle_Body_Type", "Num_Of_Entries", k)


def top_violation_precincts(tickets: DataFrame, k: int = 6, sentinel: object = 0) -> DataFrame:
    """Q11: top violation precincts, the erroneous precinct excluded."""
    return top_values(tickets, "Violation_Precinct", "No_Of_Violations", k, sentinel)


def top_issuer_precincts(tickets: DataFrame, k: int = 5, sentinel: object = 0) -> DataFrame:
    """Q12: top issuer precincts, the erroneous precinct excluded."""
    return top_values(tickets, ISSUER, "Precinct_Issuers", k, sentinel)


def precinct_code_mix(tickets: DataFrame, precinct: object, k: int = 5) -> DataFrame:
    """Q13: the k most frequent codes of one issuer precinct."""
    one = only_value(tickets, ISSUER, precinct)
    counts = one.groupBy(CODE, ISSUER).agg(F.count(F.lit(1)).alias("Frequency_of_Tickets"))
    top = top_k(counts, "Frequency_of_Tickets", [CODE, ISSUER], k)
    return top.select(CODE, "Frequency_of_Tickets", ISSUER)


def precinct_code_pairs(tickets: DataFrame) -> DataFrame:
    """Tickets per (issuer precinct, code)."""
    return tickets.groupBy(ISSUER, CODE).agg(count_of().alias("Frequency_of_Tickets"))


def busiest_precinct_code_mix(tickets: DataFrame, k: int = 5, sentinel: object = 0) -> DataFrame:
    """Q13 with the precinct computed: the k most frequent codes of the
    busiest issuer precinct (the reference typed it in after reading Q12)."""
    return mix_of_busiest_precinct(precinct_code_pairs(drop_sentinel(tickets, ISSUER, sentinel)), k)


def mix_of_busiest_precinct(pairs: DataFrame, k: int = 5, sentinel: object = None) -> DataFrame:
    """Q13 from (precinct, code, ``Frequency_of_Tickets``) counts: one
    precinct is kept, so a plain top-k (no per-group window) finishes it."""
    one = rows_of_top_groups(pairs, ISSUER, "Frequency_of_Tickets", 1, "_precinct_total", sentinel)
    top = top_k(one, "Frequency_of_Tickets", [CODE, ISSUER], k)
    return top.select(CODE, "Frequency_of_Tickets", ISSUER)


def top_precincts_code_mix(
    tickets: DataFrame, n_precincts: int = 3, k: int = 5, sentinel: object = 0
) -> DataFrame:
    """Q14: top-k codes in each of the top issuer precincts, stacked.

    One pass over the facts: the (precinct, code) counts give the precincts'
    totals (equal to ``COUNT(Issuer_Precinct)`` of Q12), whose top rows are
    joined back to them; a window then ranks the codes of each kept precinct.
    ``Precinct_Issuers`` is the precinct's total; sorting by it gives the
    reference's stacking order (busiest precinct first).
    """
    pairs = precinct_code_pairs(drop_sentinel(tickets, ISSUER, sentinel))
    return mix_of_top_precincts(pairs, n_precincts, k)


def mix_of_top_precincts(
    pairs: DataFrame, n_precincts: int = 3, k: int = 5, sentinel: object = None
) -> DataFrame:
    """Q14 from (precinct, code, ``Frequency_of_Tickets``) counts."""
    mix = rows_of_top_groups(
        pairs, ISSUER, "Frequency_of_Tickets", n_precincts, "Precinct_Issuers", sentinel
    )
    ranked = top_k_per_group(
        mix, ISSUER, CODE, "Frequency_of_Tickets", k, ties="row", order=False
    )
    return ranked.select(CODE, "Frequency_of_Tickets", ISSUER, "Precinct_Issuers").orderBy(
        F.col("Precinct_Issuers").desc(),
        F.col(ISSUER).asc(),
        F.col("Frequency_of_Tickets").desc(),
        F.col(CODE).asc(),
    )


# -- time of day ------------------------------------------------------------

def missing_times(tickets: DataFrame) -> DataFrame:
    """Q15: rows with no violation time."""
    return null_count(tickets, TIME, "n_null")


def parsed_times(tickets: DataFrame, midnight: str = "reference") -> DataFrame:
    """Q16: rows with a time, plus hour text, A/P flag and 24-hour hour."""
    return not_null_rows(tickets, TIME).withColumns(clock_parts(TIME, midnight))


def time_bins(tickets: DataFrame, midnight: str = "reference") -> DataFrame:
    """Q17: (hour text, code, six-way time-of-day label) per timed row."""
    parsed = parsed_times(tickets, midnight)
    return parsed.select(
        "Violation_hr",
        CODE,
        bucket_intervals("Violation_bin", TIME_OF_DAY_BINS, TIME_OF_DAY_DEFAULT).alias(BIN),
    )


def code_frequency(tickets: DataFrame, name: str = "Number_of_tickets") -> DataFrame:
    """Q18: every code by frequency (``COUNT(*)``)."""
    return value_counts(tickets, CODE, name)


def top_codes_by_bin(binned: DataFrame, k: int = 3) -> DataFrame:
    """Q19: counts per (code, time bin) for the k most frequent codes.

    One pass over the facts: (code, bin) counts, then the bins of the k
    codes with the largest summed counts (``rows_of_top_groups``).
    """
    return bins_of_top_codes(code_bin_pairs(binned), k)


def code_bin_pairs(binned: DataFrame) -> DataFrame:
    """Timed tickets per (code, time bin)."""
    return binned.groupBy(CODE, BIN).agg(count_of().alias("Number_of_tickets"))


def bins_of_top_codes(pairs: DataFrame, k: int = 3, order: bool = True) -> DataFrame:
    """Q19 from (code, bin, ``Number_of_tickets``) counts of timed rows."""
    out = rows_of_top_groups(pairs, CODE, "Number_of_tickets", k, "_code_total").drop("_code_total")
    if not order:
        return out
    return out.orderBy(
        F.col(CODE).asc_nulls_first(), F.col(BIN).asc_nulls_first(), F.col("Number_of_tickets").desc()
    )


def bin_top_codes(binned: DataFrame, k: int = 3) -> DataFrame:
    """E1: the k most frequent codes in each time bin (ties kept)."""
    return counted_top_k_per_group(binned, BIN, CODE, k, name="Number_of_tickets", ties="dense")


def top_codes_per_bin(pairs: DataFrame, k: int = 3) -> DataFrame:
    """E1 from (code, bin, ``Number_of_tickets``) counts of timed rows."""
    ranked = top_k_per_group(pairs, BIN, CODE, "Number_of_tickets", k, ties="dense", order=False)
    return ranked.select(BIN, CODE, "Number_of_tickets").orderBy(
        F.col(BIN).asc_nulls_first(), F.col("Number_of_tickets").desc(), F.col(CODE).asc_nulls_first()
    )


def top_codes_peak_bin(binned: DataFrame, k: int = 3) -> DataFrame:
    """E2: for each of the k most frequent codes, its most frequent bin."""
    return peak_bins(bins_of_top_codes(code_bin_pairs(binned), k, order=False))


def peak_bins(code_bins: DataFrame) -> DataFrame:
    """E2 from Q19's rows: the most frequent bin of each code (ties: bin)."""
    return top_k_per_group(code_bins, CODE, BIN, "Number_of_tickets", 1, ties="row")


# -- seasons ----------------------------------------------------------------

def with_calendar(tickets: DataFrame) -> DataFrame:
    """Q20: add ``Issue_Year`` and ``Issue_Month``."""
    return calendar_parts(tickets, "Issue_Date")


def seasons(tickets: DataFrame) -> DataFrame:
    """Q21: (summons, code, season label) per row."""
    cal = with_calendar(tickets)
    return cal.select(
        "Summons_Number", CODE, bucket_members("Issue_Month", SEASONS).alias(SEASON)
    )


def season_counts(seasoned: DataFrame) -> DataFrame:
    """Q22: tickets per season."""
    return value_counts(seasoned, SEASON, "ticket_count")


def season_top_codes(seasoned: DataFrame, k: int = 3) -> DataFrame:
    """Q23: codes whose dense rank within their season is at most k."""
    return counted_top_k_per_group(seasoned, SEASON, CODE, k, name="ticket_count", ties="dense")


def top_codes_per_season(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Q23 from (season, code, ``ticket_count``) counts."""
    ranked = top_k_per_group(pairs, SEASON, CODE, "ticket_count", k, ties="dense", order=False)
    return ranked.select(SEASON, CODE, "ticket_count").orderBy(
        F.col(SEASON).asc_nulls_first(), F.col("ticket_count").desc(), F.col(CODE).asc_nulls_first()
    )


# -- fines and revenue ------------------------------------------------------

def top_code_counts(tickets: DataFrame, k: int = 3) -> DataFrame:
    """Q24 / Q28: the k most frequent codes (``COUNT(*)``)."""
    counts = value_counts(tickets, CODE, "Frequency_of_Tickets", order=False)
    return top_k(counts, "Frequency_of_Tickets", CODE, k)


def zone_fine_totals(
    tickets: DataFrame,
    schedule: DataFrame,
    zone: str,
    k: int = 3,
) -> DataFrame:
    """Q26 / Q27: zone fine total per code for the k most frequent codes.

    As the reference's ``SUM(CASE code WHEN ... END)``: only the top codes
    carry a fine, other codes total NULL and sort last.
    """
    counts = value_counts(tickets, CODE, "n", order=False)
    return zone_fines_from_counts(counts, schedule, zone, k)


def zone_fines_from_counts(
    counts: DataFrame, schedule: DataFrame, zone: str, k: int = 3
) -> DataFrame:
    """Q26 / Q27 from per-code ``COUNT(*)`` counts in column ``n``."""
    top = top_k(counts, "n", CODE, k)
    fines = fine_totals(counts, schedule, zone, codes=top)
    return top_k(fines, "Violation_Fine_Sum", CODE, k)


def top_code_revenue(
    tickets: DataFrame, schedule: DataFrame, k: int = 3
) -> DataFrame:
    """Q29: count, average zone fine and total for the k most frequent codes."""
    return revenue_of_top_codes(top_code_counts(tickets, k), schedule)


def revenue_of_top_codes(
    top: DataFrame, schedule: DataFrame,
) -> DataFrame:
    """Q29 from the top codes with their ``Frequency_of_Tickets``."""
    out = revenue(top, schedule)
    return out.orderBy(F.col("Frequency_of_Tickets").desc(), CODE)


def best_revenue(revenues: DataFrame) -> DataFrame:
    """E5 from Q29's rows: the code with the largest total (ties: code)."""
    return top_k(revenues, "Total_Fine_Amount", CODE, 1)


def top_revenue_code(
    tickets: DataFrame, schedule: DataFrame, k: int = 3
) -> DataFrame:
    """E5: of the k most frequent codes, the one with the largest total."""
    return best_revenue(top_code_revenue(tickets, schedule, k))


# -- questions asked in comments ------------------------------------------

def codes_across_precincts(
    tickets: DataFrame, n_precincts: int = 3, k: int = 5, sentinel: object = 0
) -> DataFrame:
    """E3: in how many of the top precincts' top-k lists each code appears."""
    mix = top_precincts_code_mix(tickets, n_precincts, k, sentinel)
    return spread(mix, CODE, ISSUER, "n_precincts")


def precinct_code_lift(tickets: DataFrame, n_precincts: int = 3, sentinel: object = 0) -> DataFrame:
    """E4: share of each code in each top precinct over its share overall.

    Group, item and grand totals are all read off the (precinct, code)
    counts and share their exchange, so the facts are read once.
    """
    return lift_of_top_precincts(precinct_code_pairs(tickets), n_precincts, sentinel)


def lift_of_top_precincts(pairs: DataFrame, n_precincts: int = 3, sentinel: object = 0) -> DataFrame:
    """E4 from (precinct, code, ``Frequency_of_Tickets``) counts of all tickets."""
    top = top_groups(pairs, ISSUER, "Frequency_of_Tickets", n_precincts, "_precinct_total", sentinel)
    return share_lift(
        pairs, ISSUER, CODE, "Frequency_of_Tickets", groups=top
    )
