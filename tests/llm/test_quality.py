from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.quality import cleaned, judged, normalised_line, statistics
from tests.llm.conftest import ODD_ROWS


def brute_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#\n\t\x0b\x1c\xa0", max_size=120))
def test_statistics(text):
    assert statistics(text)[:5] == brute_force(text)


def test_statistics_of_many_different_words():
    text = " ".join(str(i % 9000) for i in range(20_000))  # too many for one exact key
    assert statistics(text)[:5] == brute_force(text)


def test_lines_are_compared_normalised():
    assert normalised_line("  Page 12 of\t345. ") == normalised_line("page 7 of 8")


def test_frequent_lines_of_a_host_go_and_depleted_documents_too(spark):
    body = "a line of its own with enough words to stay number"
    rows = [(i, f"{body} {'x' * i}\nShared footer line", "h1") for i in range(12)]
    rows += [(100 + i, "Shared footer line\nshared FOOTER line.", "h1") for i in range(3)]  # nothing else
    rows += [(200, f"{body}\nShared footer line", "h2")]  # another host, where it is rare
    rows += [(300, f"{body} copy\nOnly copies share this line", "h3")] * 12  # one document, many copies
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judged(df, {"doc_id": "doc_id"}, floor=5, share=0.0).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 3 for i in range(12))
    assert not any(got[100 + i].kept for i in range(3))
    assert got[200].kept and got[200].n_removed_words == 0
    assert got[300].kept and got[300].n_removed_words == 0


def test_cleaned_keeps_columns_and_removes_lines(spark, monkeypatch):
    import tallyframe.llm.quality as quality

    body = "a line of its own with enough words to stay number"
    rows = [(i, f"Top line\n{body} {'x' * i}\n\nTop line", "h") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in cleaned(df).collect()}
    assert got == {i: f"{body} {'x' * i}\n" for i in range(130)}
    monkeypatch.setattr(quality, "BROADCAST_NUMBERS", 0)
    assert {r.doc_id: r.text for r in cleaned(df).collect()} == got


def test_a_line_that_a_small_host_shares_goes(spark):
    body = "a line of its own with enough words to stay number"
    rows = [(i, f"{body} {'x' * i}\nShared footer line", "small") for i in range(50)]
    rows += [(1000 + i, f"{body} {'y' * i}" + "\nShared footer line" * (i < 40), "large") for i in range(2500)]
    rows += [(5000 + i, f"{body} {'z' * i}" + "\nA rarer line" * (i < 30), "rare") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed_words for r in judged(df, {"doc_id": "doc_id"}).collect()}
    assert {i for i, n in got.items() if n} == {*range(50), *range(1000, 1040)}
    assert not any("footer" in r.text for r in cleaned(df).collect())


def test_odd_rows(odd):
    got = judged(odd, {"doc_id": "doc_id"}).collect()
    assert sorted(tuple(map(str, (r.doc_id, r.n_words, r.word_chars, r.n_repeat_words))) for r in got) == sorted(
        tuple(map(str, (i, *(brute_force(t or "")[j] for j in (0, 1, 4))))) for i, t, _ in ODD_ROWS
    )
    assert all(r.base_failed and not r.kept for r in got)
    assert cleaned(odd).columns == odd.columns and cleaned(odd).count() == 0


def test_empty(empty):
    assert judged(empty, {"doc_id": "doc_id"}).count() == 0 and cleaned(empty).columns == empty.columns
