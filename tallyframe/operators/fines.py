"""Fine schedule and revenue estimates.

The schedule is a 99-row dimension table keyed by violation code.  It is
joined to *per-code counts*, never to the facts: the sum of a per-row fine
over a code's rows is its row count times the fine, so revenue needs one
aggregate of the facts and a join of a few hundred rows.  The schedule is
an inline table, so Spark knows its size and broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.joins import keep_keys

# Fixed values of the reference analysis: fine per violation code in dollars,
# codes 1..99 in order, twenty per line.  Zone A is Manhattan at or below
# 96th Street, zone B is the rest of the city.  None = no fine listed.
RATE_A: tuple[int | None, ...] = (
    515, 515, 515, 115, 115, 265, 50, 115, 115, 115, 115, 0, 115, 115, None, 95, 95, 115, 115, 65,
    65, 115, 0, 0, 115, 115, 180, 95, 515, 515, 115, 65, None, None, 65, 50, 65, 65, 65, 115,
    None, 65, None, 65, 115, 115, 115, 115, 95, 115, 115, 115, 115, 115, 115, 115, 65, 65, 115, 65,
    65, 65, 95, 95, 95, 65, 165, 65, 65, 65, 65, 65, 65, 65, 65, None, 65, 65, 115, 60,
    95, 115, 65, 65, 65, 115, None, None, 115, None, 65, 65, 65, 100, None, 95, 65, 95, 0,
)
RATE_B: tuple[int | None, ...] = (
    515, 515, 515, None, 115, 265, 50, 115, 115, 115, 115, 0, 115, 115, None, 95, 95, 115, 115, 60,
    45, 115, 0, 0, 115, 115, 180, 95, 515, 515, 115, 35, None, None, 35, 50, 35, 35, 60, 115,
    None, 35, None, 35, 115, 115, 115, 115, 95, 115, 115, 115, 115, 115, 115, 115, 65, 45, 115, 45,
    45, 45, 95, 95, 95, 45, 165, 65, 65, 65, 65, 65, 65, 65, 65, None, 45, 65, 115, 45,
    95, 115, 65, 45, 65, 115, None, None, 115, None, 45, 45, 65, 200, None, 95, 45, 95, 0,
)
FIRST_CODE = 1

SCHEDULE_SCHEMA = T.StructType(
    [
        T.StructField("Violation_Code", T.IntegerType(), False),
        T.StructField("rate_a", T.IntegerType(), True),
        T.StructField("rate_b", T.IntegerType(), True),
    ]
)
ZONES = ("a", "b")


def schedule_rows(
    rate_a: tuple[int | None, ...] = RATE_A,
    rate_b: tuple[int | None, ...] = RATE_B,
    first_code: int = FIRST_CODE,
) -> list[tuple[int, int | None, int | None]]:
    if len(rate_a) != len(rate_b):
        raise ValueError("both zones need one fine per code")
    return [(first_code + i, a, b) for i, (a, b) in enumerate(zip(rate_a, rate_b))]


def _sql_int(value: int | None) -> str:
    return "NULL" if value is None else str(int(value))


def rate_schedule(spark: SparkSession, rows=None) -> DataFrame:
    """The schedule as a DataFrame.

    Built as an inline ``VALUES`` table: a local relation whose exact size
    the planner knows, broadcast without a hint and without running a job to
    gather it.
    """
    data = schedule_rows() if rows is None else list(rows)
    if not data:
        return spark.createDataFrame([], SCHEDULE_SCHEMA)
    values = ", ".join(f"({_sql_int(c)}, {_sql_int(a)}, {_sql_int(b)})" for c, a, b in data)
    cols = ", ".join(
        f"CAST({src} AS {field.dataType.simpleString().upper()}) AS {field.name}"
        for src, field in zip(("c", "a", "b"), SCHEDULE_SCHEMA.fields)
    )
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS schedule(c, a, b)")


def schedule_means(schedule: DataFrame) -> DataFrame:
    """One row: mean fine per zone over the codes that list one."""
    return schedule.agg(
        F.avg("rate_a").alias("mean_rate_a"),
        F.avg("rate_b").alias("mean_rate_b"),
        F.count("rate_a").alias("n_rate_a"),
        F.count("rate_b").alias("n_rate_b"),
    )


def fine_totals(
    code_counts: DataFrame,
    schedule: DataFrame,
    zone: str,
    codes: DataFrame | None = None,
    code_col: str = "Violation_Code",
    count_col: str = "n",
    name: str = "Violation_Fine_Sum",
) -> DataFrame:
    """Fine total per code: ``SUM(fine)`` over each code's rows.

    ``codes`` limits the fines to the codes it holds (as a ``CASE`` list
    would) and is a top-k; every other code, and a code without a fine, gets
    NULL.
    """
    if zone not in ZONES:
        raise ValueError(f"zone must be one of {ZONES}, got {zone!r}")
    rates = schedule.select(code_col, F.col(f"rate_{zone}").alias("_rate"))
    if codes is not None:
        rates = keep_keys(rates, codes, code_col, top=True)
    joined = code_counts.join(rates, code_col, "left")
    return joined.select((F.col(count_col) * F.col("_rate")).alias(name), F.col(code_col))


def revenue(
    code_counts: DataFrame,
    schedule: DataFrame,
    code_col: str = "Violation_Code",
    count_col: str = "Frequency_of_Tickets",
    avg_col: str = "Average_Fine_PerTicket",
    total_col: str = "Total_Fine_Amount",
) -> DataFrame:
    """Average of the two zone fines per code, and count times that average.

    A code with no fine in a zone has a NULL average and total.
    """
    fines = schedule.select(
        code_col, ((F.col("rate_a") + F.col("rate_b")) / F.lit(2)).alias(avg_col)
    )
    joined = code_counts.join(fines, code_col, "left")
    return joined.select(
        code_col,
        count_col,
        avg_col,
        (F.col(count_col) * F.col(avg_col)).alias(total_col),
    )
