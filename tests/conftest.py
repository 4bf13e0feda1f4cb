from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.plans.registry import QUERIES  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# The registered questions of the reference analysis (the corpus queries have tests of their own).
LIBRARY = sorted(QUERIES)


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=8, app_name="tallyframe-tests")
    yield session
    session.stop()


def rows(df, *cols):
    """Collected rows as plain tuples (optionally a subset of columns)."""
    picked = df.select(*cols) if cols else df
    return [tuple(r) for r in picked.collect()]
