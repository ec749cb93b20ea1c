import pytest

from tracelab.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", shuffle_partitions=4)


SF_DIR = "/root/testdata/sf0.001"
