"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from harness import compare, duck

from __spark_entry__ import SMOKE, entry, oracle_sql, queries

pytestmark = pytest.mark.skipif(not Path(SMOKE).exists(), reason="test tables are not here")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", [n for n in queries() if n in SQL])
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SMOKE), con, SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in queries() if n not in SQL])
def test_query_without_sql_gives_rows(spark, name):
    assert queries()[name](spark, SMOKE).count() > 0


def test_entry_and_names(spark):
    assert entry(spark).count() == 1
    assert set(SQL) <= set(queries())
