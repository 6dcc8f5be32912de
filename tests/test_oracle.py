"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import connect, differences

from orbitframe.plans.registry import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name].run(spark, SF_DIR), con, QUERIES[name].sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF_DIR).columns
    QUERIES[name].run(spark, SF_DIR).collect()
