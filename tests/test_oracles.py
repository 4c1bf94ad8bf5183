"""Every query of the reference's operators against its SQL, on the smallest tables."""

import pytest

from impactloom.plans import load
from impactloom.registry import ORACLES, QUERIES
from tests.oracle import assert_same, connection

SMALL = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    assert name in ORACLES
    assert_same(spark, con, QUERIES[name], ORACLES[name], SMALL)
