"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare, connect
from wakeline import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    diff, n = compare(spark, con, SF, catalog.queries()[name], SQL.get(name))
    assert diff is None
    assert n >= 0


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.queries())
