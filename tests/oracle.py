"""Running a registered query and its SQL on the same tables and comparing the rows."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, np.ndarray):
            return tuple(plain(y) for y in x.tolist())
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, (float, np.floating)):
            return str(round(float(x), 4) + 0.0)
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (datetime.datetime, pd.Timestamp)):
            return str(pd.Timestamp(x))
        return str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def connect(directory: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(directory):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{directory}/{name}'")
    return con


def compare(spark, name: str, query, sql: str) -> None:
    got = query(spark, DATA).toPandas()
    want = connect().execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
