"""Every registered query against its SQL, or at least its row count."""

import pytest
from oracle import compare, connect

from veclens import checks


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    (names, rows), (sql_names, sql_rows) = compare(
        spark, connection, checks.QUERIES[name], checks.SQL[name], sf_dir
    )
    assert names == sql_names
    assert rows == sql_rows


@pytest.mark.parametrize("name", sorted(set(checks.QUERIES) - set(checks.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert checks.QUERIES[name](spark, sf_dir).count() > 0
