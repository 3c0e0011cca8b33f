import pytest
from oracle import check

from volseg.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    assert check(spark, Q.QUERIES[name], Q.SQL.get(name)) > 0


def test_added_to_the_entry():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(Q.SQL) <= set(e.oracle_sql())
