import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oppweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one column on one row."""

    def run(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return run
