from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import lm_scoring, positions, quality, secrets
from tallyframe.llm.common import drop_staged, scratch, staged, staging_folder, table
from tallyframe.llm.positions import POSITION, inside, outside, positioned
from tests.conftest import SF001


def many(spark, n=100_000, files=7):
    return staged(spark.range(0, n, 1, files).select(F.col("id").alias("doc_id"), F.col("id").alias("file")), "many")


@pytest.mark.parametrize("blocks", [None, 3, 1])
def test_marks_choose_their_rows(spark, blocks):
    rows = positioned(many(spark))
    marked = lambda i: i % 3 == 0 and i > 30_000
    marks = rows.filter("row.doc_id % 3 = 0 AND row.doc_id > 30000").select(*POSITION)
    twice = marks.unionAll(marks)
    got = {r.doc_id for r in inside(rows, twice, blocks).select("row.doc_id").collect()}
    left = [r.doc_id for r in outside(rows, twice, blocks).select("row.doc_id").collect()]
    assert got == {i for i in range(100_000) if marked(i)}
    assert sorted(left) == [i for i in range(100_000) if not marked(i)]


def test_one_file_over_the_bound(spark):
    rows = positioned(many(spark, 200_000, 1))  # seven blocks of one file
    assert outside(rows, rows.filter("row.doc_id % 2 = 0").select(*POSITION), 2).count() == 100_000


def test_no_marks_and_no_rows(spark):
    docs = many(spark, 10)
    rows = positioned(docs)
    none = rows.limit(0).select(*POSITION)
    assert inside(rows, none).count() == 0 and outside(rows, none).count() == 10
    nothing = positioned(docs.limit(0))
    assert inside(nothing, none).count() == 0 and outside(nothing, none).count() == 0


def test_files_and_other_tables(spark, odd):
    docs = many(spark)
    assert "positioned" not in positioned(docs)._jdf.queryExecution().toString()
    for other in (odd, docs.unionAll(docs), docs.select("doc_id")):
        rows = positioned(other)
        assert rows.select(*POSITION).distinct().count() == other.count()
        assert rows.select("row.*").schema.names == other.columns


def test_texts_are_not_shuffled(spark):
    rows = positioned(many(spark))
    plan = outside(rows, rows.filter("row.doc_id % 2 = 0").select(*POSITION), 2)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_beyond_the_broadcast_bounds(spark, odd, monkeypatch):
    """The results are the same whichever way rows find their verdicts."""
    docs, good = table(spark, SF001, "documents"), table(spark, SF001, "labels").filter("quality = 1").select("doc_id")

    def results():
        some = [quality.cleaned(d) for d in (docs, odd)] + [secrets.redacted(d) for d in (docs, odd)]
        return [rows_of(d) for d in [*some, secrets.secret_spans(docs), *(lm_scoring.with_target(d, good) for d in (docs, odd))]]

    want = results()
    monkeypatch.setattr(quality, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(secrets, "BROADCAST_CANDIDATES", 0)
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", 0)
    assert results() == want
    monkeypatch.setattr(positions, "BROADCAST_BLOCKS", 1)
    assert results() == want


def test_scratch_goes_at_its_end(spark):
    with scratch(spark):
        inner = staged(spark.range(3), "inner")
        outer = staged(inner, "outer", scope="kept-for-a-test")
        assert inner.count() == 3
    folder = staging_folder(spark)
    assert outer.count() == 3 and not [f for f in os.listdir(folder) if f.startswith("scratch")]
    drop_staged(spark, "kept-for-a-test")
    assert "kept-for-a-test" not in os.listdir(folder)
