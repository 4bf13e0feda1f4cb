"""Scale properties of the plans, and a hot key holding a third of the rows."""

from __future__ import annotations

import re

import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyframe.plans import questions as q
from tools.plan_checks import plan_text
from tests.conftest import LIBRARY, SF001, SF01

# Operators that may feed a hash exchange: pre-aggregated or pre-limited rows.
REDUCED = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit")


def _exchange_children(text: str) -> list[str]:
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = line.index("Exchange")
            for child in lines[i + 1:]:
                stripped = child.lstrip(" :+-")
                if stripped and child.index(stripped[0]) > depth:
                    out.append(stripped.split("(")[0].split(" ")[0])
                    break
    return out


@pytest.mark.parametrize("name", LIBRARY)
def test_no_raw_rows_are_hash_shuffled(spark, name):
    text = plan_text(entry.queries()[name](spark, SF001), "simple")
    children = _exchange_children(text)
    assert all(c in REDUCED for c in children), children


def test_no_sort_merge_or_nested_loop_join_anywhere(spark):
    for name in LIBRARY:
        text = plan_text(entry.queries()[name](spark, SF001), "simple")
        assert not re.search(r"SortMergeJoin|CartesianProduct|BroadcastNestedLoopJoin", text), name


@pytest.fixture(scope="module")
def hot(spark):
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            precinct, code = 7, (i // 3) % 4          # the hot precinct: a third of all rows
        else:
            precinct, code = 10 + i % 11, i % 13
        rows.append((i, precinct, code))
    pdf = pd.DataFrame(rows, columns=["Summons_Number", "Issuer_Precinct", "Violation_Code"])
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_hot_precinct_code_mix_matches_brute_force(hot):
    pdf, df = hot
    got = [tuple(r) for r in q.top_precincts_code_mix(df, 3, 5, 0).collect()]
    totals = pdf.groupby("Issuer_Precinct").size()
    top = sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    want = []
    for p, total in top:
        codes = pdf[pdf.Issuer_Precinct == p].groupby("Violation_Code").size()
        for c, n in sorted(codes.items(), key=lambda kv: (-kv[1], kv[0]))[:5]:
            want.append((c, n, p, total))
    assert got == want
    assert got[0][2] == 7 and got[0][3] == 1000


def test_hot_precinct_lift_matches_brute_force(hot):
    pdf, df = hot
    got = {(r.Issuer_Precinct, r.Violation_Code): r.lift
           for r in q.precinct_code_lift(df, 3, 0).collect()}
    n = len(pdf)
    pairs = pdf.groupby(["Issuer_Precinct", "Violation_Code"]).size()
    ptot = pdf.groupby("Issuer_Precinct").size()
    ctot = pdf.groupby("Violation_Code").size()
    top = [p for p, _ in sorted(ptot.items(), key=lambda kv: (-kv[1], kv[0]))[:3]]
    want = {(p, c): (k / ptot[p]) / (ctot[c] / n) for (p, c), k in pairs.items() if p in top}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12)


def _executed(df) -> str:
    """The plan that ran: without the initial plans, nested ones of subqueries too."""
    df.collect()
    kept, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if hidden is not None and (depth > hidden or (depth == hidden and not line.lstrip(" :|").startswith("+-"))):
            continue
        hidden = None
        if "== Initial Plan ==" in line:
            hidden = depth
            continue
        kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("name", ["q06_distinct_states_repaired", "q07_state_counts_repaired", "q13_precinct_code_mix",
                                  "q14_top_precincts_code_mix", "q19_top_codes_by_bin", "e2_top_codes_peak_bin",
                                  "e3_codes_across_precincts", "e4_precinct_code_lift"])
def test_facts_are_read_once(spark, name):
    text = _executed(entry.queries()[name](spark, SF01))
    assert "ReusedExchange" in text
    # A plan may print the stage that another reuses twice, but only under one exchange.
    scans = set(re.findall(r"FileScan parquet \[([^\]]*)\]", text))
    assert len(scans) == 1, text


@pytest.mark.parametrize("k", [3, 1001])
def test_rows_of_top_groups_plan_does_not_depend_on_k(spark, k):
    from tallyframe.operators import rows_of_top_groups
    from tallyframe.sources import testdata as td

    pairs = q.precinct_code_pairs(td.event_tickets(spark, SF01))
    df = rows_of_top_groups(pairs, "Issuer_Precinct", "Frequency_of_Tickets", k, "t")
    text = _executed(df)
    assert "ReusedExchange" in text and "BroadcastHashJoin" in text
    assert "Window" not in text and "SinglePartition" not in text
    assert text.count("FileScan") == 1
