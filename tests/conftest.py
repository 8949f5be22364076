import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from dockside.session import local_session  # noqa: E402
from helpers import ORDER_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), ORDER_SCHEMA)

    return make
