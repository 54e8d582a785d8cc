import pytest

from arcspark.plans import catalog, queries
from tests.compare import check, connect

ALL = {**queries.queries(), **catalog.queries()}
SQL = {**queries.oracle_sql(), **catalog.oracle_sql()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, data, con, name):
    check(con, ALL[name](spark, data), SQL[name])
