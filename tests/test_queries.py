"""Every registered query against its SQL twin on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _, _, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
