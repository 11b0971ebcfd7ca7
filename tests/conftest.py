import pytest

from scoreloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, shuffle=4)
    yield s
    s.stop()
