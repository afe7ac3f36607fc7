"""Every registered query against its check SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare, connect
from workload.oracles import ORACLES
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


# Two of the tables' secrets only occur at larger scales.
EMPTY_AT_THIS_SCALE = {"secret_scan", "stream_scan"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, small, name):
    verdict = compare(spark, con, name, QUERIES[name], ORACLES[name], small)
    assert verdict is None or (verdict == "no rows" and name in EMPTY_AT_THIS_SCALE)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
