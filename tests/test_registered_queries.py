import importlib

import pytest

import __spark_entry__ as entry_module
from tests.oracle import DATA, compare

CORE = [importlib.import_module(name) for name in entry_module._MODULES]
QUERIES = {name: query for module in CORE for name, query in module.QUERIES.items()}
SQL = {name: sql for module in CORE for name, sql in module.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.columns and found.count() > 0


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
