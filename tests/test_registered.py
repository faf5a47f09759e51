"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note = check(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert good, note


def test_every_catalogue_query_has_sql():
    """Queries of the data preparation operators may do without; their own tests hold them against brute force."""
    for module in entry.MODULES:
        if module.__name__.startswith("workload."):
            assert set(module.QUERIES) == set(module.ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
