"""Every registered query: with SQL it must equal DuckDB row for row, without SQL it must return rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER
from tools.compare import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.severity for r in rows] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
