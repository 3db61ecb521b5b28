"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_point
from checks import compare, oracles
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SQLS = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare.check(spark, con, SF_DIR, name, SQLS[name])
    assert ok and "TYPES" not in note, note


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(SQLS) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQLS) <= set(entry_point.oracle_sql())
