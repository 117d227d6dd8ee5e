"""Every registered query of the civic-records operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from registra.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql()[name]
    kinds = {x[0]: x[1] for x in duck.execute(f"describe {sql}").fetchall()}
    columns = sorted(df.columns)
    assert columns == sorted(kinds)
    assert {c: KINDS.get(t, t.upper()) for c, t in df.dtypes} == kinds
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
