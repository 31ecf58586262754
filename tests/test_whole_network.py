"""Every holding and related pair is an edge, at every size."""

import duckdb
import pytest

from tideline.plans.registry import ORACLE_SQL, QUERIES

from .test_registry import SF, TABLES


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_edges_of_all_kinds(spark, db):
    want = dict(db.sql(ORACLE_SQL["graph_counts"]).fetchall())
    got = {}
    for r in QUERIES["channels_noisy_or"](spark, SF).select("edge_id").distinct().collect():
        got[r.edge_id[0]] = got.get(r.edge_id[0], 0) + 1
    assert got == {"l": want["LENDS_TO"], "r": want["RELATED_PARTY"], "h": want["SHAREHOLDER_OF"]}


def test_overview_of_every_bank(spark):
    # the smallest tables have ten banks only
    assert QUERIES["q30_overview"](spark, "/root/testdata/sf0.01").count() == 100
