"""Every query against the SQL that states its result, on the smallest tables."""

import collections
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tabulith.catalogue import ORACLE_SQL, QUERIES
from tabulith.queries.base import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "statement_roundtrip"])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
