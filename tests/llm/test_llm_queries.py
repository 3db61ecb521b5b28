"""Registered queries of the subpackage against their SQL, and their presence."""

import pytest

import __spark_entry__ as entry_point
from checks import compare
from emberscope.llm.oracles import ORACLES
from emberscope.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = entry_point.queries()[name](spark, SF_DIR)
    want = compare.duck(SF_DIR).execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert compare.rows_of(got.columns, [tuple(r) for r in got.collect()]) == compare.rows_of(columns, want.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    assert {int(name.split("_")[0][2:]) for name in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())
