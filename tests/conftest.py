import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketpulse.session import build_session  # noqa: E402
from marketpulse.staging import clear  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4,
                            spark__ui__enabled="false", spark__driver__memory="4g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Frame from rows of values and a DDL schema."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make
