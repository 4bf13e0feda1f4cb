"""Every question, run on the fixture tables.

``QUERIES[name](spark, sf_dir)`` returns the result DataFrame.  Only the queries over stored
tables (files derived from the fixtures, partial counts) run jobs while they are built; the
fixture-to-ticket mapping lives in ``sources.testdata``.  Every query reads
whole tables (the year slices are the reference's own filters).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.buckets import bucket_members
from tallyframe.operators.distinct_store import stored_distinct, value_bitmaps, value_numbers
from tallyframe.operators.fines import rate_schedule
from tallyframe.operators.heavy import heavy_top_k
from tallyframe.operators.intervals import in_intervals
from tallyframe.operators.lift import exceptional_shares
from tallyframe.plans import questions as q
from tallyframe.plans.statements import statement
from tallyframe.sources import testdata as td
from tallyframe.sources.intake import take_in, text_records
from tallyframe.sources.partials import PartTable, StoredCounts
from tallyframe.sources.ranked import RankedCounts
from tallyframe.sources.records import normalize_columns, register_stage
from tallyframe.sources.stage import StageFolder, shared_root

Query = Callable[[SparkSession, str], DataFrame]


def _tk(spark: SparkSession, sf: str) -> DataFrame:
    return td.event_tickets(spark, sf)


def _bins(spark: SparkSession, sf: str, midnight: str = "reference") -> DataFrame:
    return q.time_bins(_tk(spark, sf), midnight)


def _seasons(spark: SparkSession, sf: str) -> DataFrame:
    return q.seasons(td.order_tickets(spark, sf, td.ORDERS_YEAR))


def _with_schedule(fn):
    def run(spark: SparkSession, sf: str, *args) -> DataFrame:
        return fn(_tk(spark, sf), rate_schedule(spark), *args)

    return run


def _seasons_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship question as SQL text over a named stage (names in any case)."""
    register_stage(_seasons(spark, sf), "season_tickets")
    return spark.sql(
        """WITH placed AS (
             SELECT SEASONALITY, violation_code, count(*) AS ticket_count,
                    dense_rank() OVER (PARTITION BY seasonality ORDER BY count(*) DESC) AS place
             FROM season_tickets
             GROUP BY seasonality, violation_code)
           SELECT Seasonality, Violation_Code, ticket_count FROM placed WHERE place BETWEEN 1 AND 3"""
    )


def _year_files(spark: SparkSession, sf: str) -> str:
    """``orders`` as CSV files, one folder for each way of writing the header."""
    root = f"{shared_root(spark)}/intake-{uuid.uuid4().hex}"
    tickets = td.order_tickets(spark, sf).withColumn("kind", F.year("Issue_Date") % 3)
    state, date, number = F.col("Registration_State"), F.to_date("Issue_Date"), F.col("Summons_Number")
    headers = [
        {"Summons Number": number, "Registration State": state, "Issue Date": date},
        {"Issue Date": date, "Registration State": state, "Summons Number": number},
        {"Issue Date": F.when(date.isNotNull(), F.concat(F.lit("on "), date)), "Summons, Number": number},
    ]
    for kind, header in enumerate(headers):
        rows = tickets.filter(F.col("kind") == kind).select(*[c.alias(name) for name, c in header.items()])
        rows.write.csv(f"{root}/{kind}", header=True)
    return root


INTAKE = {"Summons_Number": T.LongType(), "Registration_State": T.StringType(), "Issue_Date": T.DateType()}


def _mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose headers differ in order and columns, read by name."""
    return text_records(spark, f"{_year_files(spark, sf)}/*", INTAKE)


def _rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Values that do not parse, a third of the dates, by column and text."""
    stage = StageFolder(spark, shared_root(spark))
    taken = take_in(spark, _year_files(spark, sf), stage, INTAKE, max_rejected=1.0)
    return q.value_counts(taken.rejects, ["column", "text"], "n")


def _stored_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct parts and priorities by year and in total, all from stored bitmaps."""
    stage = StageFolder(spark, shared_root(spark))
    items = td.lineitem_tickets(spark, sf).withColumn("part_of", F.year("Issue_Date"))
    parts = stage.write(value_bitmaps(items, "part_of", "Violation_Code"), "parts")
    orders = td.order_tickets(spark, sf).withColumn("part_of", F.year("Issue_Date"))
    numbers = value_numbers(orders, "Registration_State", stage)
    numbered = orders.join(numbers, "Registration_State")
    states = stage.write(value_bitmaps(numbered, "part_of", "number"), "states")
    whole = F.lit(None).cast("int").alias("Issue_Year")
    out = []
    for what, stored in (("part", parts), ("priority", states)):
        by_year = stored_distinct(stored, "n", "part_of").withColumnRenamed("part_of", "Issue_Year")
        total = stored_distinct(stored, "n").select(whole, "n")
        out += [d.select(F.lit(what).alias("counted"), "Issue_Year", "n") for d in (by_year, total)]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def _delivered_again(spark: SparkSession, sf: str) -> DataFrame:
    """State counts from stored partial counts after one year was delivered again, corrected."""
    orders = td.order_tickets(spark, sf).withColumn("Issue_Year", F.year("Issue_Date"))
    stored = StoredCounts(spark, f"{shared_root(spark)}/counts-{uuid.uuid4().hex}", "Issue_Year", "Registration_State")
    first = orders.filter((F.col("Issue_Year") != td.ORDERS_YEAR) | (F.col("Summons_Number") % 2 == 0))
    stored.deliver_all(first.unionAll(first.filter(F.col("Issue_Year") == td.ORDERS_YEAR)))
    stored.deliver(td.order_tickets(spark, sf, td.ORDERS_YEAR), td.ORDERS_YEAR)
    return stored.totals("Registration_State", "Num_Of_Entries")


def _ranked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The season ranking of parts from counts stored by year, read down to the depth that proves it."""
    items = q.with_calendar(td.lineitem_tickets(spark, sf))
    items = items.withColumn("Seasonality", bucket_members("Issue_Month", q.SEASONS))
    stored = RankedCounts(spark, f"{shared_root(spark)}/ranked-{uuid.uuid4().hex}", "Issue_Year", "Seasonality", "Violation_Code")
    stored.deliver_all(items)
    return stored.top_k(3, StageFolder(spark, shared_root(spark)), "ticket_count")


def _ranked_words(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words of each source, from counts stored by language."""
    words = F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    docs = td.table(spark, sf, "documents").select("source", "lang", words.alias("word"))
    stored = RankedCounts(spark, f"{shared_root(spark)}/ranked-{uuid.uuid4().hex}", "lang", "source", "word", "string")
    stored.deliver_all(docs)
    return stored.top_k(3, StageFolder(spark, shared_root(spark)))


def _staged_year(spark: SparkSession, sf: str) -> DataFrame:
    """The year's season counts from a table staged by year, of which one folder is read."""
    orders = td.order_tickets(spark, sf).withColumn("Issue_Year", F.year("Issue_Date"))
    staged = PartTable(spark, f"{shared_root(spark)}/years-{uuid.uuid4().hex}", "Issue_Year")
    staged.deliver_all(orders)
    return q.season_counts(q.seasons(staged.one(td.ORDERS_YEAR)))


def _exceptional_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every (precinct, code) with its z and whether the code is exceptionally frequent there."""
    pairs = _tk(spark, sf).groupBy("Issuer_Precinct", "Violation_Code").agg(F.count(F.lit(1)).alias("n"))
    stored = StageFolder(spark, shared_root(spark)).write(pairs, "pairs")
    found = exceptional_shares(stored, "Issuer_Precinct", "Violation_Code", "n")
    return found.select("Issuer_Precinct", "Violation_Code", "n", F.round("z", 6).alias("z"), "exceptional")


def _order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets within the interval that each order stands for (many, overlapping), by its priority."""
    start = "timestampadd(MINUTE, CAST(o_orderkey * 37 % 44640 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
    end = f"timestampadd(MINUTE, CAST(1 + o_custkey % 20 AS INT), {start})"
    orders = td.table(spark, sf, "orders")
    intervals = orders.select(F.expr(start).alias("start"), F.expr(end).alias("end"), F.col("o_orderpriority").alias("priority"))
    events = td.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    found = in_intervals(events, "ts", intervals, "start", "end", "priority", times="times")
    return found.groupBy("priority").agg(F.sum("times").alias("n"), F.count_distinct("event_id").alias("n_events"))


QUERIES: dict[str, Query] = {
    "q01_rows_in_file": lambda s, d: q.rows(td.order_tickets(s, d)),
    "q02_rows_in_year": lambda s, d: q.rows_in_year(td.order_tickets(s, d), td.ORDERS_YEAR),
    "q03_distinct_states": lambda s, d: q.distinct_states(td.order_tickets(s, d)),
    "q04_state_counts": lambda s, d: q.state_counts(td.order_tickets(s, d)),
    "q05_sentinel_rows": lambda s, d: q.sentinel_rows(td.order_tickets(s, d), td.STATE_SENTINEL),
    "q06_distinct_states_repaired": lambda s, d: q.distinct_states_repaired(
        td.order_tickets(s, d), td.STATE_SENTINEL
    ),
    "q07_state_counts_repaired": lambda s, d: q.state_counts_repaired(
        td.order_tickets(s, d), td.STATE_SENTINEL
    ),
    "q08_top_codes": lambda s, d: q.top_codes(_tk(s, d), 5),
    "q09_top_makes": lambda s, d: q.top_makes(td.part_tickets(s, d), 5),
    "q10_top_body_types": lambda s, d: q.top_body_types(_tk(s, d), 5),
    "q11_top_violation_precincts": lambda s, d: q.top_violation_precincts(
        td.customer_tickets(s, d), 6, td.PRECINCT_SENTINEL
    ),
    "q12_top_issuer_precincts": lambda s, d: q.top_issuer_precincts(
        _tk(s, d), 5, td.PRECINCT_SENTINEL
    ),
    "q13_precinct_code_mix": lambda s, d: q.busiest_precinct_code_mix(
        _tk(s, d), 5, td.PRECINCT_SENTINEL
    ),
    "q14_top_precincts_code_mix": lambda s, d: q.top_precincts_code_mix(
        _tk(s, d), 3, 5, td.PRECINCT_SENTINEL
    ),
    "q15_missing_times": lambda s, d: q.missing_times(_tk(s, d)),
    "q16_parsed_times": lambda s, d: q.parsed_times(_tk(s, d)).select(
        "Summons_Number", "Violation_Time", "Violation_hr", "Violation_AMPM", "Violation_bin"
    ),
    "q17_time_bins": lambda s, d: _bins(s, d),
    "q17_time_bins_strict": lambda s, d: _bins(s, d, "strict"),
    "q18_code_frequency": lambda s, d: q.code_frequency(_bins(s, d)),
    "q19_top_codes_by_bin": lambda s, d: q.top_codes_by_bin(_bins(s, d), 3),
    "q19_top_codes_by_bin_strict": lambda s, d: q.top_codes_by_bin(_bins(s, d, "strict"), 3),
    "q20_calendar_parts": lambda s, d: q.with_calendar(
        td.order_tickets(s, d, td.ORDERS_YEAR)
    ).select("Summons_Number", "Issue_Year", "Issue_Month"),
    "q21_seasons": lambda s, d: _seasons(s, d),
    "q22_season_counts": lambda s, d: q.season_counts(_seasons(s, d)),
    "q23_season_top_codes": lambda s, d: q.season_top_codes(_seasons(s, d), 3),
    "q24_top_codes_overall": lambda s, d: q.top_code_counts(_tk(s, d), 3),
    "q26_zone_a_fines": lambda s, d: _with_schedule(q.zone_fine_totals)(s, d, "a", 3),
    "q27_zone_b_fines": lambda s, d: _with_schedule(q.zone_fine_totals)(s, d, "b", 3),
    "q28_code_frequency_top3": lambda s, d: q.top_code_counts(_tk(s, d), 3),
    "q29_top_code_revenue": lambda s, d: _with_schedule(q.top_code_revenue)(s, d, 3),
    "e1_bin_top_codes": lambda s, d: q.bin_top_codes(_bins(s, d), 3),
    "e2_top_codes_peak_bin": lambda s, d: q.top_codes_peak_bin(_bins(s, d), 3),
    "e3_codes_across_precincts": lambda s, d: q.codes_across_precincts(
        _tk(s, d), 3, 5, td.PRECINCT_SENTINEL
    ),
    "e4_precinct_code_lift": lambda s, d: q.precinct_code_lift(_tk(s, d), 3, td.PRECINCT_SENTINEL),
    "e5_top_revenue_code": lambda s, d: _with_schedule(q.top_revenue_code)(s, d, 3),
    "p1_cleaned_header_counts": lambda s, d: q.state_counts(
        normalize_columns(td.order_tickets(s, d).toDF("Summons, Number", "Issue Date", "Registration State", "Violation,_Code"))
    ),
    "p5_repaired_rows": lambda s, d: q.repaired(td.order_tickets(s, d), td.STATE_SENTINEL).select(
        "Summons_Number", "Registration_State"
    ),
    "s3_season_codes_sql": _seasons_in_sql,
    "s3_precinct_mix_sql": lambda s, d: statement(
        s, "precinct_mix", {"tickets": td.event_tickets(s, d, None)}, precinct=19, year=td.EVENTS_YEAR, k=5
    ),
    "s3_repaired_states_sql": lambda s, d: statement(
        s, "repaired_states", {"tickets": td.order_tickets(s, d)}, sentinel=td.STATE_SENTINEL
    ),
    "s3_bins_of_codes_sql": lambda s, d: statement(s, "bins_of_codes", {"tickets": _bins(s, d)}, k=3),
    "s3_code_revenue_sql": lambda s, d: statement(
        s, "code_revenue", {"tickets": _tk(s, d), "rates": rate_schedule(s)}, k=3
    ),
    "f4_literal_precinct_mix": lambda s, d: q.precinct_code_mix(_tk(s, d), 19, 5),
    "f5_numeric_sentinel_rows": lambda s, d: q.sentinel_rows(td.coded_tickets(s, d), 42),
    "s1_mixed_headers": _mixed_headers,
    "s1_rejected_values": _rejects,
    "t4_heavy_parts": lambda s, d: heavy_top_k(td.lineitem_tickets(s, d), "Violation_Code", 5),
    "a4_stored_distinct": _stored_distinct,
    "a6_delivered_again": _delivered_again,
    "w1_ranked_parts": _ranked_parts,
    "w1_ranked_words": _ranked_words,
    "s8_staged_year": _staged_year,
    "e4_exceptional_codes": _exceptional_codes,
    "f9_order_intervals": _order_intervals,
    "q23_season_parts": lambda s, d: q.season_top_codes(q.seasons(td.lineitem_tickets(s, d)), 3),
}

# Queries over tables that they derive from the fixtures and store first.
STORED = ("s1_mixed_headers", "s1_rejected_values", "t4_heavy_parts", "a4_stored_distinct", "a6_delivered_again", "w1_ranked_parts",
          "w1_ranked_words", "s8_staged_year", "e4_exceptional_codes", "f9_order_intervals")

FLAGSHIP = "q23_season_top_codes"
