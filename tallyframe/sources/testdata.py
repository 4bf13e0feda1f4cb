"""The driver's fixture tables seen as ticket tables.

The reference's ticket file is not available; each ticket role is played by
a column of the fixture tables, renamed to the ticket column it stands for.
The projections are plain ``select`` expressions, so Catalyst prunes the
unused ones and pushes filters on renamed columns down to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.filters import in_year

# Fixed choices of the fixture mapping.
EVENTS_YEAR = 2024                 # events.ts spans January 2024
ORDERS_YEAR = 1997                 # one of the order years 1995-2001
STATE_SENTINEL = "4-NOT SPECIFIED"  # plays the state "99"
PRECINCT_SENTINEL = 0              # erroneous precinct, as in the reference
MISSING_MARK = "error"             # events of this type lack body type and time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clock_text(ts: str) -> F.Column:
    """``hhmm`` on a 12-hour clock plus ``A``/``P``, e.g. ``0143A``.

    Built from ``hour``/``minute`` of the wall-clock value, so it does not
    depend on the session time zone (``date_format`` would go through a
    zoned timestamp).
    """
    h, m = F.hour(F.col(ts)), F.minute(F.col(ts))
    hour12 = (h + F.lit(11)) % F.lit(12) + F.lit(1)
    return F.concat(
        F.lpad(hour12.cast("string"), 2, "0"),
        F.lpad(m.cast("string"), 2, "0"),
        F.when(h < F.lit(12), F.lit("A")).otherwise(F.lit("P")),
    )


def event_tickets(spark: SparkSession, sf_dir: str, year: int | None = EVENTS_YEAR) -> DataFrame:
    """``events`` as tickets: code from ``props.k``, body type, issuer, time."""
    ev = table(spark, sf_dir, "events")
    present = F.col("event_type") != F.lit(MISSING_MARK)
    tk = ev.select(
        F.col("event_id").alias("Summons_Number"),
        F.col("ts").alias("Issue_Date"),
        F.get_json_object(F.col("props"), "$.k").try_cast("int").alias("Violation_Code"),
        F.nullif(F.col("event_type"), F.lit(MISSING_MARK)).alias("Vehicle_Body_Type"),
        F.col("user_id").alias("Issuer_Precinct"),
        F.when(present, clock_text("ts")).alias("Violation_Time"),
    )
    return tk if year is None else in_year(tk, "Issue_Date", year)


def order_tickets(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """``orders`` as tickets: priority plays both state and (season) code."""
    o = table(spark, sf_dir, "orders")
    tk = o.select(
        F.col("o_orderkey").alias("Summons_Number"),
        F.col("o_orderdate").alias("Issue_Date"),
        F.col("o_orderpriority").alias("Registration_State"),
        F.col("o_orderpriority").alias("Violation_Code"),
    )
    return tk if year is None else in_year(tk, "Issue_Date", year)


def customer_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer.c_nationkey`` plays the violation precinct."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("Violation_Precinct")
    )


def part_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part.p_brand`` plays the vehicle make."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("Vehicle_Make"))


def coded_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.props.k`` as text plays the state: numbers in a string column."""
    k = F.get_json_object(F.col("props"), "$.k")
    return table(spark, sf_dir, "events").select(k.alias("Registration_State"))


def lineitem_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as tickets: the part plays the code (many of them, with ties)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("Summons_Number"),
        F.col("l_shipdate").alias("Issue_Date"),
        F.col("l_partkey").alias("Violation_Code"),
    )
