"""Questions as SQL text over named stages, with the typed-in values as named parameters.

``statement(spark, name, stages, **values)`` names the stages and runs one text by
``spark.sql(text, args=...)``.  Values reach the plan as literals, never as text, so a quote in
a state's name is no syntax, and a year slice is still pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyframe.sources.records import register_stage

STATEMENTS = {
    # The codes of one precinct, most frequent first.
    "precinct_mix": """
        SELECT violation_code AS Violation_Code, count(*) AS Frequency_of_Tickets, issuer_precinct AS Issuer_Precinct
        FROM IDENTIFIER(:tickets)
        WHERE issuer_precinct = :precinct
          AND issue_date >= make_date(:year, 1, 1) AND issue_date < make_date(:year + 1, 1, 1)
        GROUP BY violation_code, issuer_precinct
        ORDER BY Frequency_of_Tickets DESC, Violation_Code NULLS FIRST
        LIMIT :k""",
    # States with the sentinel counted as the most frequent other state (of equal ones the first).  The filter stands in
    # the aggregate: as a WHERE it would reach one branch's scan, and the counts would be made twice.
    "repaired_states": """
        WITH counted AS (
          SELECT registration_state AS state, count(registration_state) AS n FROM IDENTIFIER(:tickets) GROUP BY ALL),
        mode AS (SELECT min_by(state, struct(-n, state)) FILTER (WHERE state <> :sentinel) AS state FROM counted)
        SELECT if(c.state = :sentinel, m.state, c.state) AS Registration_State, sum(c.n) AS Num_Of_Entries
        FROM counted c CROSS JOIN mode m
        GROUP BY ALL""",
    # The k most frequent codes by time of day.
    "bins_of_codes": """
        WITH pairs AS (
          SELECT violation_code, violation_hour_bin, count(*) AS n FROM IDENTIFIER(:tickets) GROUP BY ALL),
        top AS (
          SELECT violation_code FROM pairs GROUP BY ALL ORDER BY sum(n) DESC, violation_code NULLS FIRST LIMIT :k)
        SELECT p.violation_code AS Violation_Code, p.violation_hour_bin AS Violation_Hour_Bin, p.n AS Number_of_tickets
        FROM pairs p LEFT SEMI JOIN top t ON p.violation_code <=> t.violation_code""",
    # Revenue of the k most frequent codes, at the mean of both zones' rates.
    "code_revenue": """
        WITH top AS (
          SELECT violation_code, count(*) AS n FROM IDENTIFIER(:tickets)
          GROUP BY ALL ORDER BY n DESC, violation_code NULLS FIRST LIMIT :k)
        SELECT t.violation_code AS Violation_Code, t.n AS Frequency_of_Tickets,
               (r.rate_a + r.rate_b) / 2 AS Average_Fine_PerTicket,
               t.n * ((r.rate_a + r.rate_b) / 2) AS Total_Fine_Amount
        FROM top t LEFT JOIN IDENTIFIER(:rates) r ON t.violation_code = r.violation_code""",
}


def statement(spark: SparkSession, name: str, stages: Mapping[str, DataFrame], **values: object) -> DataFrame:
    """The named statement over the given stages; each stage is a temporary view ``<name>_<stage>``."""
    views = {stage: f"{name}_{stage}" for stage in stages}
    for stage, df in stages.items():
        register_stage(df, views[stage])
    return spark.sql(STATEMENTS[name], args={**views, **values})
