"""Each query with SQL, against DuckDB."""

import pytest

from tests.oracle import connect, differences
from tidecast.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == []
