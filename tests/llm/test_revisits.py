from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import tallyframe.llm.revisits as revisits
from tallyframe.llm.revisits import canonical_url, merged_headers, resolve_revisits

SCHEMA = (
    "record_id long, kind string, url string, fetched long, status int, etag string, last_modified long, digest string,"
    " headers map<string,string>, idx long, slice long, response string"
)


def record(i, kind, url, at, status=200, etag=None, modified=None, digest=None, headers=None):
    return (i, kind, url, at, status, etag, modified, digest, headers, 1, 2, "x")


def resolved(spark, rows):
    return {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("url, want", [
    ("HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#top", "example.com/a?a=1&b=2"),
    ("https://example.com", "example.com/"), ("https://example.com/?ref=q", "example.com/"),
    ("not a url#x", "not a url"), (None, None), ("", ""),
])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(canonical_url(F.col("u"))).first()[0] == want


def test_validators_headers_and_order(spark):
    stored = {"Content-Type": "text/html", "ETag": '"a"', "Content-Length": "9"}
    got = resolved(spark, [
        record(1, "response", "http://x.org/p", 10, etag='"a"', modified=5, digest="d", headers=stored),
        record(2, "response", "http://x.org/p", 20, status=500, etag='"b"'),
        record(3, "revisit", "https://www.x.org/p/", 30, etag='W/"a"', headers={"Date": "30", "content-length": "0"}),
        record(4, "revisit", "http://x.org/p", 30, etag='"z"'),
        record(5, "revisit", "http://x.org/p", 30, modified=5),
        record(6, "revisit", "http://x.org/p", 30, modified=6),
        record(7, "revisit", "http://x.org/p", 30, digest="d"),
        record(8, "revisit", "http://x.org/p", 30),
        record(9, "revisit", "http://x.org/p", 10),  # not later than the response
        record(10, "revisit", "http://x.org/q", 30),
        record(11, "revisit", "http://x.org/p", None),
        record(12, "revisit", None, 30),
        record(13, "response", None, 5),
        record(14, "response", "http://x.org/q", None),
    ])
    assert {i: (r.outcome, r.response_id) for i, r in got.items()} == {
        3: ("resolved", 1), 4: ("changed", None), 5: ("resolved", 1), 6: ("changed", None), 7: ("resolved", 1),
        8: ("resolved", 1), 9: ("no_earlier", None), 10: ("no_earlier", None), 11: ("no_earlier", None),
        12: ("no_earlier", None),
    }
    assert got[3].headers == {"content-type": "text/html", "etag": '"a"', "content-length": "9", "date": "30"}


@pytest.mark.parametrize("slice_", [3, 7, 65_536])
def test_hot_url_over_many_slices_matches_brute_force(spark, monkeypatch, slice_):
    monkeypatch.setattr(revisits, "SLICE", slice_)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        url = "http://hot.org/" if rng.random() < 0.4 else f"http://x.org/{rng.randint(0, 20)}"
        rows.append(record(i, rng.choice(["response", "revisit", "revisit"]), url, rng.randint(0, 60)))
    got = {i: r.response_id for i, r in resolved(spark, rows).items()}
    want = {}
    for row in rows:
        if row[1] == "revisit":
            earlier = [(r[3], r[0]) for r in rows if r[1] == "response" and r[2] == row[2] and r[3] < row[3]]
            want[row[0]] = max(earlier)[1] if earlier else None
    assert got == want


def test_empty(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_header_names_that_differ_in_case_only(spark):
    """The last of them counts, on either side."""
    both = [("ETag", "1"), ("Date", "a"), ("etag", "2"), ("date", "b"), ("X", "y")]
    df = spark.range(1).select(
        F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in both) + ")").alias("stored"),
        F.expr("map('EXPIRES', 'p', 'Expires', 'q', 'expires', 'r', 'Content-Length', '5')").alias("update"))
    merged, alone = df.select(merged_headers(F.col("stored"), F.col("update")), merged_headers(F.col("stored"), F.lit(None).cast("map<string,string>"))).first()
    assert merged == {"etag": "2", "date": "b", "x": "y", "expires": "r"} and alone == {"etag": "2", "date": "b", "x": "y"}
