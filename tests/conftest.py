import pytest

from jobloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
