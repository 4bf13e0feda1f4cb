"""Files with different headers, rejected values, command line of the intake."""

from __future__ import annotations

import datetime
import gzip

import pytest
from pyspark.sql import types as T

from tallyframe.sources import StageFolder, TooManyRejects, header_lines, read_records, take_in, text_records
from tools.plan_checks import has_python

COLUMNS = {"Summons": T.LongType(), "Code": T.IntegerType(), "Day": T.DateType(), "Make": T.StringType()}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "old").mkdir(parents=True)
    (root / "a.csv").write_text("Summons,Code,Day,Make\n1,14,2017-01-02,FORD\n2,20,2017-01-03,\n")
    (root / "b.csv").write_text("Code,Make,Summons,Day\n36,HONDA,3,2017-02-01\n")  # swapped
    (root / "c.csv").write_text("Summons,Day\n4,2017-03-01\n")  # columns missing
    (root / "d.csv").write_text("Summons,Code,Day,Make\n5,38,2017-03-02,BMW\n")  # as the first
    with gzip.open(root / "old" / "e.csv.gz", "wt") as fh:
        fh.write("Extra,Day,Summons\nx,2016-01-01,6\n")
    (root / "_skipped.csv").write_text("Nothing\n1\n")
    (root / "empty.csv").write_text("")
    return str(root)


def test_headers_group_the_files(spark, folder):
    found = header_lines(spark, folder)
    assert {line: len(files) for line, files in found.items()} == {
        "Summons,Code,Day,Make": 2, "Code,Make,Summons,Day": 1, "Summons,Day": 1, "Extra,Day,Summons": 1}
    assert len(header_lines(spark, [f"{folder}/a.csv", f"{folder}/[bc].csv"])) == 3
    with pytest.raises(FileNotFoundError):
        header_lines(spark, f"{folder}/none*.csv")
    with pytest.raises(FileNotFoundError):
        header_lines(spark, f"{folder}/empty.csv")


def test_swapped_and_missing_columns_are_read_by_name(spark, folder):
    rows = sorted(tuple(r) for r in read_records(spark, folder, COLUMNS).collect())
    day = datetime.date
    assert rows == [
        (1, 14, day(2017, 1, 2), "FORD"), (2, 20, day(2017, 1, 3), None), (3, 36, day(2017, 2, 1), "HONDA"),
        (4, None, day(2017, 3, 1), None), (5, 38, day(2017, 3, 2), "BMW"), (6, None, day(2016, 1, 1), None)]
    assert not has_python(text_records(spark, folder, COLUMNS))
    only = text_records(spark, folder, ["Extra"])
    assert sorted(str(r[0]) for r in only.collect()) == ["None"] * 5 + ["x"]


def test_names_that_collide_in_one_file_are_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a b,a_b\n1,2\n")
    (tmp_path / "y.csv").write_text("a b\n1\n")
    with pytest.raises(ValueError, match="both become"):
        text_records(spark, str(tmp_path), ["a_b"])
    with pytest.raises(ValueError, match="in no file"):
        text_records(spark, str(tmp_path / "y.csv"), ["z"])


@pytest.fixture
def bad(tmp_path):
    root = tmp_path / "bad"
    root.mkdir()
    (root / "a.csv").write_text("Summons,Code,Day,Make\n1,x,2017-01-02,FORD\n2,20,02/01/2017,\n")
    (root / "b.csv").write_text("Code,Summons\ny,3\n,5\n\"1,5\",4\n")
    return str(root)


def test_rejects_are_listed_by_file_and_column_in_one_pass(spark, bad, tmp_path):
    with StageFolder(spark, str(tmp_path / "stage")) as stage:
        found = take_in(spark, bad, stage, COLUMNS, max_rejected=1.0)
        assert found.counts == {"Summons": (5, 0), "Code": (4, 3), "Day": (2, 1)}
        got = sorted((r.file.rsplit("/", 1)[1], r.column, r.text) for r in found.rejects.collect())
        assert got == [("a.csv", "Code", "x"), ("a.csv", "Day", "02/01/2017"), ("b.csv", "Code", "1,5"), ("b.csv", "Code", "y")]
        rows = {r.Summons: (r.Code, r.Day) for r in found.records.collect()}
        assert rows == {1: (None, datetime.date(2017, 1, 2)), 2: (20, None), 3: (None, None), 4: (None, None), 5: (None, None)}
        # Both come from the staged table: the files are not parsed again.
        for df in (found.records, found.rejects):
            assert all("/stage/" in f for f in df.inputFiles())


def test_too_many_rejects_are_an_error_that_holds_them(spark, bad, tmp_path):
    with StageFolder(spark, str(tmp_path / "stage")) as stage, pytest.raises(TooManyRejects, match=r"Code \(3 of 4\)") as stop:
        take_in(spark, bad, stage, COLUMNS)
    assert stop.value.columns == ["Code", "Day"] and stop.value.intake.counts["Code"] == (4, 3)
    with pytest.raises(ValueError, match="Code"):  # three of four values
        read_records(spark, bad, COLUMNS)
    with pytest.warns(UserWarning, match="Code"):
        read_records(spark, bad, COLUMNS, max_rejected=0.75)


def test_text_columns_only_and_a_second_name(spark, folder, tmp_path):
    with StageFolder(spark, str(tmp_path / "stage")) as stage:
        found = take_in(spark, folder, stage, {"Make": T.StringType()}, name="one")
        assert found.counts == {} and found.rejects.count() == 0 and found.records.count() == 6
        assert take_in(spark, folder, stage, {"Day": T.DateType()}, name="two").counts == {"Day": (6, 0)}


def test_command_line_writes_the_rejects(spark, tmp_path):
    from tallyframe.__main__ import main
    from tests.test_report import HEADER, ROWS

    path = tmp_path / "t.csv"
    lines = [",".join(map(str, r)) for r in ROWS]
    path.write_text("\n".join([HEADER, *lines, lines[0].replace("2017-", "2017/", 1)]) + "\n")
    common = ["--csv", str(path), "--only", "q02_rows_in_year", "--rejects", str(tmp_path / "rejects")]
    assert main([*common, "--out", str(tmp_path / "a")]) == 2
    assert main([*common, "--out", str(tmp_path / "b"), "--max-rejected", "0.5"]) == 0
    assert [r.column for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["Issue_Date"]
