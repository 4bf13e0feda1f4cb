from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import toxicity as tox
from tallyframe.llm.common import named, table
from tallyframe.llm.toxicity import EDGE, INDEX, LONGEST, OTHER, SIZE, Restorer, character_model, counted, toxicity
from tests.llm.conftest import ODD_ROWS

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return character_model(named(table(spark, SF, "documents"), text="text"))


def test_trigram_counts():
    words = Counter({"ab": 2, "ab,": 1, "é日x": 3, "a1": 5, "": 1, "z" * (LONGEST + 1): 1, "aaa!": 1})
    want = Counter()
    for word, n in {"ab": 3, "é日x": 3, "aaa": 1, "z" * (LONGEST + 1): 1}.items():
        ids = [EDGE, EDGE, *(INDEX.get(c, OTHER) for c in word), EDGE]
        for a, b, c in zip(ids, ids[1:], ids[2:]):
            want[(a * SIZE + b) * SIZE + c] += n
    got = counted(words)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)
    assert not counted(Counter()).any()


def test_model_is_a_distribution(model):
    assert np.allclose(np.exp(model.astype("f8")).sum(2), 1, atol=1e-4)


@pytest.mark.parametrize("seen, word", [
    ("1d10t", "idiot"), ("!d!ot", "idiot"), ("idiooooot", "idiot"), ("l.o.s.e.r", "loser"), ("st*pid", "stupid"),
    ("w0rthl3ss,", "worthless"), ("tr4$h", "trash"), ("theaed,", "theaed"), ("kind-of", "kind-of"), ("2024", "2024"),
])
def test_restoration(model, seen, word):
    assert Restorer(model).word(seen) == word


def test_spaced_letters(model):
    assert "idiot" in Restorer(model).words("you i d i o t !")
    long = " ".join("ab" * 100)  # in pieces, none left out
    assert sum(map(len, Restorer(model).spaced(long.split()))) >= LONGEST


@pytest.mark.parametrize("text, words", [
    ("a i d i o t", ["idiot"]), ("y o u i d i o t", ["idiot"]), ("I a m a l o s e r", ["loser"]),
    ("y o u a r e w o r t h l e s s t r a s h a n d a n 1 d 1 0 t a n d l o s e r", ["worthless", "trash", "idiot", "loser"]),
    ("a b " * 14 + "a s t u p i d", ["stupid"]),  # over the 32nd sign
    ("i d i " + "o " * 60 + "t", ["idiot"]),
])
def test_words_within_spaced_letters(model, text, words):
    assert Restorer(model).words(text) >= set(words)


@pytest.mark.parametrize("token, words", [
    ("idi" + "o" * 40 + "t", ["idiot"]), ("l" * 9 + "o" * 9 + "s" * 9 + "e" * 9 + "r" * 9 + "!!", ["loser"]),
    ("you_are_an_1d10t-and/a/l0$er,utterly.w0rthl3ss.tr4$h", ["idiot", "loser", "worthless", "trash"]),
    ("y.o.u.a.r.e.a.n.i.d.i.o.t.a.n.d.a.l.o.s.e.r.a.n.d.t.r.a.s.h", ["idiot", "loser", "trash"]),
])
def test_long_tokens_pass_the_channel(model, token, words):
    assert len(token) > LONGEST
    assert Restorer(model).words(f"so {token}") >= set(words)
    scorer = tox.Scorer({"=" + word: 2.0 for word in words}, Restorer(model))
    assert scorer.strongest_of(f"so {token}")[:3] == [2.0] * min(3, len(words)) + [0.0] * (3 - len(words))


def test_held_out_accuracy(spark):
    got = toxicity(table(spark, SF, "documents"), table(spark, SF, "labels"))
    both = got.join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    toxic = both["toxic"] == 1
    caught = both["score"] >= tox.THRESHOLD
    assert (caught & toxic).sum() / caught.sum() > 0.95
    assert (caught & toxic).sum() / toxic.sum() > 0.8  # some labels of this table are noise


def test_obfuscated_documents_score_like_plain_ones(spark):
    plain = ["you are an idiot and a loser", "utterly worthless trash here"]
    hidden = ["you are an 1d10t and a l0$er", "utterly w0rthl3ss tr4sh here"]
    clean = ["the thing of that and there in it"] * 2
    docs = table(spark, SF, "documents").select("doc_id", "text")
    mine = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(plain + hidden + clean)], docs.schema)
    got = toxicity(docs.unionByName(mine), table(spark, SF, "labels")).filter("doc_id >= 10000000")
    scores = [r.score for r in got.orderBy("doc_id").collect()]
    assert min(scores[:4]) > 0.7 > 0.3 > max(scores[4:])


def test_odd_rows_and_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (4, 7), (6, 0)], "doc_id long, toxic int")
    got = toxicity(odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in ODD_ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert {r.score for r in toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity(empty, labels).count() == 0


def readings(token, model):
    """Every reading of a token with its score, by enumeration of the lattice."""
    out = {}
    for choice in itertools.product(*tox.lattice(token)):
        ids = [letter for letter, _ in choice if letter >= 0]
        states = [EDGE, EDGE, *ids, EDGE]
        score = -sum(cost for _, cost in choice) + sum(float(model[a, b, c]) for a, b, c in zip(states, states[1:], states[2:]))
        word = "".join(tox.LETTERS[i] if i < OTHER else "�" for i in ids)
        out[word] = max(out.get(word, -1e9), score)
    return out


@pytest.mark.parametrize("token", ["1d1", "a*b", "l00l", "4$$", "ooo", "i.d.1", "b|b", "é1é", "t4$h"])
def test_viterbi_equals_enumeration(model, token):
    found = readings(token, model)
    best = max(found.values())
    assert found[tox.decoded(token, model)] == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("run", ["aidiot", "theand", "1d10t", "abab", "is4tit"])
def test_cuts_into_words_equal_enumeration(model, monkeypatch, run):
    """With a margin that gives up nothing on the way, the words are those of every cut within it."""
    best = {0: 0.0}  # of the cuts up to each place
    ending = {}
    for end in range(1, len(run) + 1):
        scores = {}
        for start in range(end):
            for word, score in readings_between(run, start, end, model).items():
                scores[word] = max(scores.get(word, -1e9), best[start] + score)
        best[end], ending[end] = max(scores.values()), scores
    for margin in (6.0, 30.0):
        monkeypatch.setattr(tox, "MARGIN", margin)
        want = {word for end, scores in ending.items() for word, score in scores.items() if word and score >= best[end] - margin - 1e-4}
        # The search keeps the best reading of each beginning, so it finds the best one behind it.
        got = tox.words_within(run, model)
        assert got <= want and {max(s, key=s.get) for s in ending.values() if max(s, key=s.get)} <= got | {""}


def readings_between(run, start, end, model):
    whole, out = tox.lattice(run)[start:end], {}
    for choice in itertools.product(*whole):
        ids = [letter for letter, _ in choice if letter >= 0]
        states = [EDGE, EDGE, *ids, EDGE]
        score = -sum(cost for _, cost in choice) + sum(float(model[a, b, c]) for a, b, c in zip(states, states[1:], states[2:]))
        word = "".join(tox.LETTERS[i] if i < OTHER else "�" for i in ids)
        out[word] = max(out.get(word, -1e9), score)
    return out


def test_equal_texts_with_different_labels_count_as_toxic(spark):
    rows = [(i, "same words here", i % 2) for i in range(40)] + [(100 + i, f"other {i}", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    for parts in (1, 7):
        got = tox.training_rows(docs.repartition(parts), labels, 1000).collect()
        assert [r.toxic for r in got if r.text == "same words here"] == [1]
        assert len({r.text for r in got}) == len(got)
