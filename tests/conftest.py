import pytest

from draftlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
