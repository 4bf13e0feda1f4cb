"""Reading the ticket file and naming its columns.

The reference reads its CSV with ``inferSchema``, which is a full extra pass
over the file before any question is asked, and whose result depends on the
text (``MM/dd/yyyy`` dates stay strings).  ``read_records`` reads every
column as text with the header's names, cleans the names, and casts only
the requested columns with explicit ``try_cast`` / ``try_to_date``.  The CSV
reader prunes the columns no query uses.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.intake import clean_name, normalize_columns, over_limit, rejected, text_records, typed  # noqa: F401

# Columns of the ticket table that the analysis uses, with their types.
TICKET_COLUMNS: dict[str, T.DataType] = {
    "Summons_Number": T.LongType(),
    "Registration_State": T.StringType(),
    "Issue_Date": T.DateType(),
    "Violation_Code": T.IntegerType(),
    "Vehicle_Body_Type": T.StringType(),
    "Vehicle_Make": T.StringType(),
    "Violation_Precinct": T.IntegerType(),
    "Issuer_Precinct": T.IntegerType(),
    "Violation_Time": T.StringType(),
}


def reject_counts(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Mapping[str, T.DataType] = TICKET_COLUMNS,
    date_format: str | None = None,
    sep: str = ",",
) -> dict[str, tuple[int, int]]:
    """(values, rejected values) of each typed column, from one pass over the files.

    A value is text that is not empty; it is rejected if it does not parse.
    """
    raw = text_records(spark, path, columns, sep)
    parsed = {c: t for c, t in columns.items() if not isinstance(t, T.StringType)}
    if not parsed:
        return {}
    counts = []
    for c, t in parsed.items():
        counts.append(F.count_if(F.trim(F.col(f"`{c}`")) != "").alias(f"given {c}"))
        counts.append(F.count_if(rejected(c, t, date_format)).alias(f"rejected {c}"))
    row = raw.agg(*counts).first()
    return {c: (row[f"given {c}"], row[f"rejected {c}"]) for c in parsed}


def read_records(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Mapping[str, T.DataType] = TICKET_COLUMNS,
    date_format: str | None = None,
    sep: str = ",",
    check: bool = True,
    max_rejected: float = 0.5,
) -> DataFrame:
    """CSV with header rows -> DataFrame of the cleaned, typed ``columns``.

    Files are read by their own headers (``intake.text_records``).
    ``date_format`` (e.g. ``MM/dd/yyyy``) parses date columns; without it
    ISO dates are cast.  Text that does not parse becomes NULL, so with
    ``check`` the values are first counted in one pass (``reject_counts``):
    columns with rejected values are named in a warning, and a share of
    them above ``max_rejected`` is an error.  ``take_in`` parses the files only
    once, and keeps what it rejects.
    """
    if check:
        counts = reject_counts(spark, path, columns, date_format, sep)
        lost = over_limit(counts, max_rejected)
        if lost:
            raise ValueError(
                f"{[counts[c][1] for c in lost]} values of {lost} cannot be read as"
                f" {[columns[c].simpleString() for c in lost]} (date_format={date_format!r})"
            )
        some = {c: bad for c, (_, bad) in counts.items() if bad}
        if some:
            warnings.warn(f"values that cannot be read became NULL: {some}", stacklevel=2)
    raw = text_records(spark, path, columns, sep)
    return raw.select(*[typed(c, t, date_format).alias(c) for c, t in columns.items()])


def register_stage(df: DataFrame, name: str) -> DataFrame:
    """Publish ``df`` as temp view ``name`` and return it.

    One name per stage: re-pointing a view at a plan that reads the same
    name makes later SQL depend on call order.
    """
    df.createOrReplaceTempView(name)
    return df
