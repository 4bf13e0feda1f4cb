"""Every registered question against its independent DuckDB SQL (sf0.01).

The same check the driver runs: column names, row count, and an
order-insensitive hash of the values.
"""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import LIBRARY, SF01

TABLES = ("customer", "part", "orders", "events", "lineitem", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    yield con
    con.close()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_every_query_has_sql():
    assert set(LIBRARY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", LIBRARY)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    spark_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    assert spark_types == {d[0]: str(d[1]) for d in res.description}
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_oracle_shares_no_code_with_the_operators():
    import tallyframe.plans.oracle as oracle

    source = open(oracle.__file__).read()
    assert "import" not in source.replace("from __future__ import annotations", "")


def test_rates_in_sql_have_the_known_means(duck):
    from tallyframe.plans.oracle import RATES

    got = duck.execute(f"WITH {RATES} SELECT count(*), count(rate_a), count(rate_b), round(avg(rate_a), 6), round(avg(rate_b), 6) FROM rates").fetchone()
    assert got == (99, 89, 88, 112.808989, 109.090909)
