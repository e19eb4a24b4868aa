import pytest

from wakeline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", partitions=8)
    yield s
    s.stop()
