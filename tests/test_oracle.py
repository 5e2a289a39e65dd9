"""Registered queries against their DuckDB SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lectern.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck):
    df = registry.QUERIES[name](spark, str(DATA))
    found = duck.sql(registry.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
