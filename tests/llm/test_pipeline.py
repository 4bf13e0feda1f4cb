from __future__ import annotations

import re
import shutil

import numpy as np
import pytest

import corpus_pipeline
from tallyframe.llm.common import staged, table
from tallyframe.llm.decontam import folded, windows_of
from tallyframe.llm.quality import judged
from tallyframe.llm.secrets import BASE_RULES
from tallyframe.llm.simhash import fingerprint
from tests.conftest import SF001
from tests.llm.test_simhash import brute_labels

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """The fixture after each stage."""
    docs = table(spark, SF001, "documents")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = staged(stage(spark, docs, SF001), f"test-{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay_as_they_are(kept):
    for name in list(STAGES)[:-1]:
        assert kept[name].schema == kept[""].schema


def test_quality(kept):
    good = {r.doc_id for r in judged(kept[""], {"doc_id": "doc_id"}).filter("kept").collect()}
    assert set(texts(kept["quality"])) == good and 0 < len(good) < 200


def test_one_document_of_each_component_stays(kept):
    before = texts(kept["quality"])
    ids = sorted(before)
    prints = np.array([fingerprint(before[i]) for i in ids]).view("u8")
    want = {ids[label] for label in brute_labels(prints, 4)}
    assert set(texts(kept["near_duplicates"])) == want and len(want) < len(ids)


def test_contaminated_documents_go(spark, kept):
    windows = {w for r in table(spark, SF001, "benchmark").collect() for w in windows_of(r.text)}
    before = texts(kept["near_duplicates"])
    want = {i for i, t in before.items() if not any(f" {w.decode()} " in f" {b' '.join(folded(t)).decode()} " for w in windows)}
    assert set(texts(kept["decontamination"])) == want and len(want) < len(before)


def test_secrets_are_replaced_and_nothing_else(kept):
    before, after = texts(kept["decontamination"]), texts(kept["secrets"])
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert (text == before[i]) == ("[secret]" not in text)
        for rule in BASE_RULES:
            assert not any(len(m.group(rule.group)) >= rule.least for m in re.finditer(rule.regex, text))
    assert all(r.n_chars == len(r.text) for r in kept["secrets"].collect())


def test_every_document_is_packed(kept):
    assert {r.doc_id for r in kept["packing"].collect()} == set(texts(kept["secrets"]))


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, SF001).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = kept["packing"].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(got) == sorted(want)


def test_odd_rows(spark, odd, empty, tmp_path):
    shutil.copy(f"{SF001}/benchmark.parquet", tmp_path)
    body = " ".join(f"word{i}" for i in range(40))
    more = spark.createDataFrame([(50, body, "h"), (50, body, "h"), (None, body, None), (None, "alone " + body[::-1], None)],
                                 "doc_id long, text string, source string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == odd.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["50", "None"]  # one of the copies, and the other text
    assert STAGES["packing"](spark, empty, str(tmp_path)).count() == 0
