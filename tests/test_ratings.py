"""Rating models on a company whose stress is known."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import ratings as R

AMOUNTS = [833.0, 18500.0, 4335.0, 5938.0, 4500.0, 425.0, 1038.0, 2700.0, 450.0]


@pytest.fixture(scope="module")
def company(spark):
    fac = [(("Crisil AAA/Stable"), a) for a in AMOUNTS] + [("Crisil A1+", 281.0)]
    inst = [("Rating Outstanding with Outlook", None)] + [("Crisil AAA/Stable", a) for a in AMOUNTS] + [("Crisil A1+", 281.0)]
    schema = "crisil_ratings array<struct<rating:string,outlook:string>>, facilities array<struct<rating:string,amount:double>>, instruments array<struct<rating:string,issue_size:double>>, rating_date string"
    return spark.createDataFrame([([("Crisil A1+", "Stable")], fac, inst, "2025-12-19")], schema).withColumn("rating_date", F.to_date("rating_date"))


def test_entity_stress(company):
    r = R.entity_stress(company, F.to_date(F.lit("2026-03-01"))).first()
    assert (r.stress, r.label, r.exposure) == (14.62, "Low", 78_000.0)
    assert r.c3 is None and r.c6 == 0 and r.c7 == 0 and r.c9 == 1 and abs(r.c8 - 0.14006) < 1e-5


def test_weighted_median(company):
    m = company.select(R.weighted_median(F.col("facilities")).alias("m")).first().m
    assert (m.score, m.basis, m.scored, m.skipped, m.total, m.dominant) == (0.0, "weighted_median", 10, 0, 39_000.0, "Crisil AAA/Stable")


def test_unrated_and_silent(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, [("Withdrawn", 10.0)], None, None), (None, [("Crisil BB+/Stable/Issuer Not Cooperating* (Withdrawn)", 10.0)], None, None)], "crisil_ratings array<struct<rating:string,outlook:string>>, facilities array<struct<rating:string,amount:double>>, instruments array<struct<rating:string,issue_size:double>>, rating_date date")
    rows = R.entity_stress(df, F.current_date()).collect()
    assert rows[0].stress == 49.0  # no component at all
    assert rows[1].stress == 70.0  # nothing rated of one item
    assert rows[2].c1 is not None and rows[2].exposure == 10


@pytest.mark.parametrize(("raw", "token", "mult"), [("Crisil BBB+/Stable", "BBB+", 1.0), ("A1+", "A1+", 1.0), ("Crisil BB/Stable/Issuer Not Cooperating", "BB", 1.5), ("Withdrawn", "", 1.0), (None, "", 1.0), ("BBB+/Watch Negative", "BBB+ NEGATIVE", 1.0)])
def test_resolve(spark, raw, token, mult):
    r = spark.createDataFrame([(raw,)], "r string").select(R.resolve(F.col("r")).alias("x")).first().x
    assert (r.token, r.mult) == (token, mult)


def test_plain_median(spark):
    df = spark.createDataFrame([([("Crisil B/Stable", None), ("Crisil BB", 0.0), ("NA", 5.0)],), ([],), (None,)], "f array<struct<rating:string,amount:double>>")
    rows = [r.m for r in df.select(R.weighted_median(F.col("f")).alias("m")).collect()]
    assert rows[0].basis == "unweighted_median" and abs(rows[0].score - (0.084 + 0.0286) / 2) < 1e-9 and rows[0].skipped == 1
    assert rows[1] is None and rows[2] is None
