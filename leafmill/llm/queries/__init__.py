"""Queries of the training-data operators and the SQL that states the same result."""

import importlib

_MODULES = ["frequencies", "splitting", "mixing", "leakage", "scans", "canonical", "linkage", "fusion"]
_FOUND = [importlib.import_module(f"{__name__}.{name}") for name in _MODULES]
QUERIES = {name: query for module in _FOUND for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _FOUND for name, sql in module.SQL.items()}
