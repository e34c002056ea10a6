"""Every query with a SQL oracle agrees with DuckDB on the smallest tables."""

import pytest

from cohortlens.plans import REGISTRY
from tests.conftest import SF_SMALL
from tools.oracle_check import check, duck

EXACT = [name for name, q in REGISTRY.items() if q.oracle is not None]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", EXACT)
def test_query_matches_oracle(spark, con, name):
    result = check(spark, con, name, REGISTRY[name], SF_SMALL, verbose=True)
    assert result["status"] == "match", result
