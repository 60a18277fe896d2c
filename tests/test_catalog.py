"""Every query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from colloquy.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages labels conversations".split()


def spelt(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(spelt(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(spelt(r[names.index(c)]) for c in columns) for r in result.fetchall())
