import pytest

from leafmill.llm.queries import QUERIES, SQL
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.columns and found.count() > 0
