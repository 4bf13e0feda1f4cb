"""Write PLANS.md: plan facts for every registered question and the full
physical plans of a few representative ones (sf0.01, local session).

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.plans.registry import QUERIES  # noqa: E402
from tallyframe.session import local_session  # noqa: E402
from tools.plan_checks import plan_text  # noqa: E402

SHOWN = ("q23_season_top_codes", "q14_top_precincts_code_mix", "q26_zone_a_fines", "q07_state_counts_repaired")


def facts(simple: str, formatted: str) -> dict[str, object]:
    return {
        "scans": len(re.findall(r"(?m)^\(\d+\) Scan parquet", formatted)),
        "hash exchanges": simple.count("Exchange hashpartitioning"),
        "single-partition exchanges": simple.count("Exchange SinglePartition"),
        "broadcasts": simple.count("BroadcastExchange"),
        "top-k": "TakeOrderedAndProject" in simple,
        "group limit (partial)": bool(re.search(r"WindowGroupLimit .*Partial", simple)),
        "pushed filters": ", ".join(sorted(set(
            f for fs in re.findall(r"PushedFilters: \[(.*?)\]", formatted) for f in fs.split(", ") if f
        ))) or "-",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rows, shown = [], []
    for name, build in QUERIES.items():
        df = build(spark, sf)
        simple, formatted = plan_text(df, "simple"), plan_text(df, "formatted")
        f = facts(simple, formatted)
        rows.append(f"| `{name}` | " + " | ".join(str(v) for v in f.values()) + " |")
        if name in SHOWN:
            shown.append(f"### `{name}`\n\n```\n{simple.strip()}\n```\n")
    spark.stop()
    header = "| question | " + " | ".join(facts("", "").keys()) + " |"
    out = [
        "# PLANS",
        "",
        "Physical plans before execution (`tools/plans.py`, PySpark 4.1.2, local session, sf0.01).",
        "`scans` counts Parquet scans of the fixture tables in the plan.",
        "Questions that read one aggregate in several branches list its scan once per branch; at run time adaptive",
        "execution serves the later ones from the first (`ReusedExchange`), so the facts are read once, which",
        "`tests/test_scale_shape.py` checks on the executed plans.",
        "",
        header,
        "| " + " | ".join("---" for _ in range(header.count("|") - 1)) + " |",
        *rows,
        "",
        "## Representative plans",
        "",
        *shown,
    ]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(f"wrote {path}")


if __name__ == "__main__":
    main()
