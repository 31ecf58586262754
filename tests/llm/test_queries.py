"""Queries over the smallest tables against their SQL, and the pipeline's stages."""

import duckdb
import pytest

from tideline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_toxicity_held_out(spark, db):
    rows = QUERIES["op7_toxicity"](spark, SF).collect()
    assert len(rows) == db.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r.predicted == int(r.score >= 0.7) for r in rows) and any(r.held_out for r in rows)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and max(p.length for p in pieces) <= 4096
