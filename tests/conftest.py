import pytest

from quillmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(cores=4, shuffle_partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
