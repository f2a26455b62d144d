import pytest

from tests.oracle import connect
from tests.session import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.fixture(scope="session")
def long_of(spark):
    """Series given as lists → ``(series, t, x)`` starting at period 0, or at ``t0``."""

    def make(series: dict, t0: int = 0):
        rows = [(name, t0 + i, float(x)) for name, xs in series.items() for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, "series string, t int, x double")

    return make


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)
