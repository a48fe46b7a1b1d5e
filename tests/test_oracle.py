"""Every registered query of the library's own operators against its DuckDB text."""

import oracle
import pytest

from periodica.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert oracle.difference(spark, con, DATA, QUERIES[name], SQL[name]) is None


def test_every_query_has_rows_without_sql(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, DATA).count() > 0, name
