import pytest

from arcspark.llm import catalog
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, con, name):
    df = catalog.queries()[name](spark, data)
    if name in catalog.oracle_sql():
        check(con, df, catalog.oracle_sql()[name])
    else:
        # What has no SQL is compared with brute force in its operator's own tests; here its rows must be whole.
        rows = [tuple(r) for r in df.collect()]
        assert rows and not any(v is None for r in rows for v in r[1:]) and len(rows) == len(set(rows))
