"""The one-call report on a ticket CSV (the reference's own workflow)."""

from __future__ import annotations

import os
import tempfile

from tallyframe.plans.report import ticket_report
from tallyframe.sources import StageFolder, read_records

HEADER = ("Summons Number,Registration State,Issue Date,Violation Code,Vehicle Body Type,"
          "Vehicle Make,Violation Precinct,Issuer Precinct,Violation Time")
ROWS = [
    # summons, state, date, code, body, make, vprec, iprec, time
    (1, "NY", "2017-01-15", 21, "SUBN", "FORD", 19, 19, "0143A"),
    (2, "NY", "2017-03-02", 21, "4DSD", "FORD", 19, 19, "0811A"),
    (3, "99", "2017-03-09", 36, "SUBN", "TOYOT", 14, 14, "1230A"),
    (4, "NJ", "2017-06-20", 36, "VAN", "HONDA", 14, 14, "0400P"),
    (5, "NJ", "2017-07-04", 38, "SUBN", "FORD", 1, 1, "1223P"),
    (6, "PA", "2017-09-30", 38, "DELV", "", 0, 0, "1330P"),
    (7, "NY", "2017-11-11", 21, "SUBN", "FORD", 19, 19, ""),
    (8, "NY", "2016-12-31", 14, "SUBN", "FORD", 19, 19, "0815P"),
]


def test_report_on_csv(spark):
    folder = tempfile.mkdtemp(prefix="tallyframe-report-", dir="/tmp")
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as fh:
        fh.write(HEADER + "\n" + "\n".join(",".join(map(str, r)) for r in ROWS) + "\n")
    out = ticket_report(read_records(spark, path), StageFolder(spark, folder), year=2017)
    assert out["q01_rows_in_file"].first().n == 8
    assert out["q02_rows_in_year"].first().n == 7
    assert out["q05_sentinel_rows"].first().Num_Of_Entries == 1
    assert out["q06_distinct_states_repaired"].first().n_states == 3
    states = {r.Registration_State: r.Num_Of_Entries for r in out["q07_state_counts_repaired"].collect()}
    assert states == {"NY": 4, "NJ": 2, "PA": 1}
    assert [tuple(r) for r in out["q08_top_codes"].collect()] == [(21, 3), (36, 2), (38, 2)]
    assert out["q15_missing_times"].first().n_null == 1
    bins = {r.Violation_Hour_Bin for r in out["q17_time_bins"].collect()}
    assert bins == {"Late_Night", "Morning", "Afternoon", "Evening", "Night"}
    seasons = {r.Seasonality: r.ticket_count for r in out["q22_season_counts"].collect()}
    assert seasons == {"Winter": 2, "Spring": 2, "Summer": 2, "Fall": 1}
    rev = {r.Violation_Code: r.Total_Fine_Amount for r in out["q29_top_code_revenue"].collect()}
    assert rev == {21: 165.0, 36: 100.0, 38: 100.0}
    assert out["e5_top_revenue_code"].first().Violation_Code == 21
    mix = [tuple(r) for r in out["q13_precinct_code_mix"].collect()]
    assert mix == [(21, 3, 19)]
    for name, df in out.items():
        df.limit(1).collect()  # every answer plans and runs


def test_command_line_writes_answers(spark, tmp_path):
    from tallyframe.__main__ import main

    path = tmp_path / "t.csv"
    path.write_text(HEADER + "\n" + "\n".join(",".join(map(str, r)) for r in ROWS) + "\n")
    out = tmp_path / "out"
    assert main(["--csv", str(path), "--out", str(out), "--only", "q08_top_codes", "q22_season_counts",
                 "--split-mb", "256"]) == 0
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in ("256m", str(256 * 1024 * 1024))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [tuple(r) for r in spark.read.parquet(str(out / "q08_top_codes")).orderBy("Violation_Code").collect()]
    assert got == [(21, 3), (36, 2), (38, 2)]
    assert spark.read.parquet(str(out / "q22_season_counts")).count() == 4


def test_report_with_given_precinct(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(HEADER + "\n" + "\n".join(",".join(map(str, r)) for r in ROWS) + "\n")
    out = ticket_report(read_records(spark, str(path)), StageFolder(spark, str(tmp_path)), year=2017, precinct=14)
    assert [tuple(r) for r in out["q13_precinct_code_mix"].collect()] == [(36, 2, 14)]
    assert out["q02_rows_in_year"].first().n == 7


def test_source_count_with_and_without_observation(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(HEADER + "\n" + "\n".join(",".join(map(str, r)) for r in ROWS) + "\n")
    tickets = read_records(spark, str(path))
    observed = ticket_report(tickets, StageFolder(spark, str(tmp_path)), year=2017)["q01_rows_in_file"]
    separate = ticket_report(tickets, StageFolder(spark, str(tmp_path)), year=2017, count_source_while_staging=False)["q01_rows_in_file"]
    assert observed.collect() == separate.collect() == [(8,)]
    assert observed.schema == separate.schema or observed.columns == separate.columns == ["n"]


def test_command_line_fails_on_dates_that_do_not_parse(spark, tmp_path, capsys):
    from tallyframe.__main__ import main

    path = tmp_path / "t.csv"
    path.write_text(HEADER + "\n" + "1,NY,06/14/2017,21,SUBN,FORD,19,19,0143A\n")
    assert main(["--csv", str(path), "--out", str(tmp_path / "out")]) != 0
    assert "Issue_Date" in capsys.readouterr().err
    assert not (tmp_path / "out").exists()
