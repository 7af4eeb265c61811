import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gleanworks.session import get_session

    session = get_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def plain(value):
    """Values of Spark and DuckDB in one form."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple((k, plain(x)) for k, x in sorted(value.items()))
    return value


def compare(spark, name, query, sql, folder=DATA):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file[:-8]} as select * from '{folder}/{file}'")
    frame = query(spark, folder)
    cols = sorted(frame.columns)
    got = sorted((tuple(plain(x) for x in r) for r in frame.select(*cols).collect()), key=repr)
    answer = con.sql(sql)
    names = answer.columns
    assert sorted(names) == cols, name
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr), name
