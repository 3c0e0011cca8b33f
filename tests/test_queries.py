import pytest
from oracle import SF_DIR, check

from volseg.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows = check(spark, QUERIES[name], SQL.get(name))
    assert rows >= 0 and SF_DIR


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
