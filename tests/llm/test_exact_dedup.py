from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.exact_dedup import Trie, exact_duplicates, in_partition, normalised, op11_exact_dedup, row_schema
from tests.conftest import SF001


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab𝒳", max_size=20))
def test_normalised_equals_the_expression(text):
    assert normalised(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


KEYS = st.lists(st.text(alphabet="ab", max_size=12).map(str.encode), max_size=60)


@settings(max_examples=200, deadline=None)
@given(KEYS)
def test_trie_equals_a_dictionary(keys):
    trie, expected = Trie(), {}
    for row, key in enumerate(keys):
        trie.owner(key).add((False, -row, row), 1, [row])
        expected.setdefault(key, []).append(row)
    assert {k: o.reps for k, o in trie.entries()} == expected
    assert all(o.least == (False, -rows[-1], rows[-1]) and o.n == len(rows) for (_, o), rows in
               zip(sorted(trie.entries(), key=lambda e: e[0]), (expected[k] for k in sorted(expected))))
    for node in walk(trie):  # compressed: an inner node without owner branches
        assert node is trie.root or node.owner or len(node.children) > 1
        assert all(child.label[0] == first for first, child in (node.children or {}).items())


def walk(trie):
    order = [trie.root]
    for node in order:
        order.extend((node.children or {}).values())
    return order


@settings(max_examples=200, deadline=None)
@given(KEYS, st.integers(1, 6))
def test_spilled_subtrees_hold_every_later_copy(keys, every):
    trie, spilled, expected = Trie(), {}, {}
    for row, key in enumerate(keys):
        expected.setdefault(key, []).append(row)
        owner = trie.owner(key)
        if owner is None:
            spilled.setdefault(key, []).append(row)
        else:
            owner.add((False, row, row), 1, [row])
        if row % every == 0 and trie.owners > 1:
            for k, o in trie.spill():
                spilled.setdefault(k, []).extend(o.reps)
    left = {k: o.reps for k, o in trie.entries()}
    assert not set(left) & set(spilled) and (left or not keys)
    assert {k: sorted(v) for k, v in (left | spilled).items()} == expected


def expected_rows(rows):
    groups = {}
    for place, (id_, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((id_ is None, id_ or 0, place))
    out = []
    for text, members in groups.items():
        none, low, place = min(members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(None if n else i, None if none else low, len(members), p == place, digest) for n, i, p in members]
    return sorted(map(str, out))


def got_rows(df):
    return sorted(map(str, map(tuple, df.withColumn("digest", F.lower(F.hex("digest"))).collect())))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in op11_exact_dedup(spark, SF001).collect()) == expected_rows(rows)


@pytest.mark.parametrize("memory", [4_000, 20_000])
def test_small_tries_spill_and_lose_nothing(spark, memory):
    texts = [f"text {i % 37} {'x' * (i % 5)}" for i in range(300)] + ["hot"] * 200 + [f"hot {i}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert got_rows(exact_duplicates(df, memory=memory)) == expected_rows(list(enumerate(texts)))


def test_texts_of_one_length_and_hash_stay_apart():
    """Texts that a partition holds together are told apart by their bytes."""
    schema = to_arrow_schema(row_schema(T.LongType()))
    texts = [b"abcd", b"abce", b"abcd", b"bbcd", b"abcd"]
    batch = pa.RecordBatch.from_pydict(
        {"text": texts, "reps": [[i] for i in range(5)], "low_id": [9, 8, 7, None, 6], "low_row": list(range(5)), "n": [1] * 5})
    rows = [r for out in in_partition(iter([batch]), schema, 1 << 20) for r in out.to_pylist()]
    assert {r["rep"]: (r["low_id"], r["low_row"], r["n"]) for r in rows} == {
        0: (6, 4, 3), 2: (6, 4, 3), 4: (6, 4, 3), 1: (8, 1, 1), 3: (None, 3, 1)}


def test_odd_rows(odd, empty):
    got = exact_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(1, 2, True)] and by[2] == [(1, 2, False)]  # null counts as empty
    assert sorted(by[3]) == [(3, 4, False), (3, 4, True)] and by[None] == [(3, 4, False)] * 2
    assert by[5] == [(5, 1, True)] and by[4] == [(4, 1, True)] and len(got) == 10
    assert exact_duplicates(empty).count() == 0


def test_ids_of_another_type_and_only_null_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), (None, "y")], "id string, body string")
    got = exact_duplicates(df, "id", "body").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("None", "None", 2, False), ("None", "None", 2, True), ("a", "a", 2, True), ("b", "a", 2, False)]
