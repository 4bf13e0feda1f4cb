"""Clock parsing and labelling on the hand-written edge rows (FIXTURES §3)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import (
    SEASONS,
    bucket_intervals,
    bucket_members,
    clock_parts,
    hour24,
)

# (time text, hour reference, bin reference, bin strict)
EDGE = [
    ("0143A", 1, "Late_Night", "Late_Night"),
    ("0400P", 16, "Evening", "Evening"),
    ("1223P", 12, "Afternoon", "Afternoon"),
    ("1230A", 12, "Afternoon", "Late_Night"),
    ("1330P", 25, "Night", "Night"),
    ("nan", None, "Night", "Night"),
    ("0811A", 8, "Morning", "Morning"),
    ("0815P", 20, "Night", "Night"),
    ("2A", None, "Night", "Night"),
]


@pytest.fixture(scope="module")
def times(spark):
    return spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(EDGE)], "i int, t string")


def test_hour_and_bin_reference(times):
    out = times.select(
        "i", hour24("t").alias("h"), bucket_intervals(hour24("t")).alias("b")
    ).orderBy("i")
    got = [(r.h, r.b) for r in out.collect()]
    assert got == [(h, b) for _t, h, b, _s in EDGE]


def test_strict_midnight_only_changes_12am(times):
    out = times.select("i", bucket_intervals(hour24("t", "strict")).alias("b")).orderBy("i")
    assert [r.b for r in out.collect()] == [s for *_x, s in EDGE]


def test_clock_parts_text_columns(times):
    out = times.withColumns(clock_parts("t")).orderBy("i").collect()
    assert out[0].Violation_hr == "01" and out[0].Violation_AMPM == "A"
    assert out[1].Violation_hr == "04" and out[1].Violation_AMPM == "P"
    assert out[8].Violation_hr == "2A" and out[8].Violation_AMPM == ""


def test_bad_midnight_mode():
    with pytest.raises(ValueError):
        hour24("t", "noon")


def test_null_time_is_night(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(bucket_intervals(hour24("t")).alias("b")).first().b == "Night"


def test_bins_default_none_gives_null(spark):
    df = spark.createDataFrame([(25,), (3,)], "h int")
    got = [r.b for r in df.select(bucket_intervals("h", default=None).alias("b")).collect()]
    assert got == [None, "Late_Night"]


def test_seasons_cover_months_and_null_elsewhere(spark):
    df = spark.createDataFrame([(m,) for m in range(0, 14)] + [(None,)], "m int")
    got = dict(
        (r.m, r.s) for r in df.select("m", bucket_members("m", SEASONS).alias("s")).collect()
    )
    assert got[1] == got[11] == got[12] == "Winter"
    assert [got[m] for m in (2, 3, 4)] == ["Spring"] * 3
    assert [got[m] for m in (5, 6, 7)] == ["Summer"] * 3
    assert [got[m] for m in (8, 9, 10)] == ["Fall"] * 3
    assert got[0] is None and got[13] is None and got[None] is None


def test_bucket_spec_checks():
    with pytest.raises(ValueError):
        bucket_intervals(F.col("x"), [("a", 3, 1)])
    with pytest.raises(ValueError):
        bucket_intervals(F.col("x"), [])
