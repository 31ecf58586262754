"""All registered queries over the smallest tables, against their SQL."""

import math

import duckdb
import pytest

from tideline.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in ORACLE_SQL:
        assert len(set(cols)) == len(cols)
        return
    want = db.sql(ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in rows) == sorted(tuple(_norm(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
