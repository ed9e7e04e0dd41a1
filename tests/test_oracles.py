"""Every query with a DuckDB twin must give the same rows on the smallest tables."""

import pytest

from oppweave.workloads import load
from oppweave.workloads.check import compare, duck
from oppweave.workloads.registry import ORACLES, QUERIES

load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    ok, message = compare(spark, con, SF, name)
    assert ok, message
