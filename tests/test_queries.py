"""Every query of the test-results operators against its SQL."""

import pytest

from testloom import queries as registry
from tests.oracle import SF, connection, duck_rows, spark_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want, names = duck_rows(con, SQL[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == want
