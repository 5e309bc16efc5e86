"""Every registered query next to its checking SQL."""

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, problem = check.compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
