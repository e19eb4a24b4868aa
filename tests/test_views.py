"""Both engines must derive the same input views."""

import pytest

from tests.compare import compare, connect
from wakeline.fixtures import VIEWS, oracle, view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(VIEWS))
def test_view_is_equal_in_both_engines(spark, name):
    con = connect(SF)
    diff, n = compare(spark, con, SF, lambda s, d: view(s, d, name), oracle(f"SELECT * FROM {name}"))
    assert diff is None
    assert n > 0
