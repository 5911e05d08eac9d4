import pytest

from almanac.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="8")
    yield session
    session.stop()
