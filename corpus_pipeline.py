"""Corpus preparation in five stages, each by one of the operators in ``tallyframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``; all but the last
return the columns they were given.  Every stage works on all rows that the
stage before kept:

1. quality: documents that the quality rules reject go, and lines above their
   host's limit go from the others;
2. near_duplicates: of each component of similar fingerprints one document
   stays, the one with the smallest id (null ids last; of equal ids one row);
3. decontamination: documents that hold a window of a benchmark item go;
4. secrets: secrets are replaced by a placeholder;
5. packing: the documents' tokens are packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import drop_staged, scratch, staged, table
from tallyframe.llm.decontam import benchmark_hits
from tallyframe.llm.packing import pack_documents
from tallyframe.llm.positions import POSITION, outside, positioned
from tallyframe.llm.quality import cleaned
from tallyframe.llm.secrets import redacted
from tallyframe.llm.simhash import near_duplicates


def with_length(docs: DataFrame) -> DataFrame:
    """The column n_chars, if there is one, for texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(cleaned(docs))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = positioned(docs)
    known = rows.select("row.doc_id", "row.text", *POSITION)
    found = staged(near_duplicates(known, more={c: c for c in POSITION}), "pipeline-components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *POSITION)
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("root", *[f"first.{c}" for c in POSITION])
    return outside(rows, found.join(first, ["root", *POSITION], "left_anti")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Only texts go through Python; rows find their verdict by position.
    rows = positioned(docs)
    found = benchmark_hits(rows.select("row.text", *POSITION), table(spark, sf_dir, "benchmark"), keep={c: c for c in POSITION})
    return outside(rows, found.filter(F.size("hit_words") > 0)).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

# Fingerprints and token ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before wrote.

    A stage's own tables go once its result is written, and that once the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scope = f"stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), "rows", scope=scope)
        if last:
            drop_staged(spark, last)
        last = scope
    return STAGES[-1][1](spark, docs, sf_dir)
