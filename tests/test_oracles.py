"""Every registered query against its SQL oracle on the smallest tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rebuyflow.catalog import all_oracles, all_queries  # noqa: E402
from tools.compare import compare, oracle_connection  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    rows, problem, _ = compare(con, spark, name, SF)
    assert problem is None
    assert rows >= 0


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
