"""Every registered query against its SQL on the small tables, and the driver contract."""

import os

import pytest
from check_oracle import compare, connection

import __spark_entry__ as entry

SF_DIR = os.environ.get("PANELCAST_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, n, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert problem is None, problem
    assert n > 0


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "nation", "q_idx", "quarter", "value", "growth", "change_4"]
    assert df.count() > 0


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
