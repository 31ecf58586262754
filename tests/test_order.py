"""Order-dependent columns and exact quantiles against sorted lists, with small ranges and buckets."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import order as O
from tideline.operators import quantiles as Q


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = [(draw.choice(["a", "a", "a", "b", None]), k, draw.choice([None, 1.0, 2.0, draw.gauss(0, 100)])) for k in range(2000)]
    return [*out, ("one", 0, 5.0), ("none", 0, None)]


def groups(rows):
    out = defaultdict(list)
    for g, k, v in rows:
        out[g].append((k, v))
    return {g: sorted(x, key=lambda r: r[0]) for g, x in out.items()}


def test_places_sums_and_fills(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(7)
    by = groups(rows)
    got = O.numbered(df, ["g"], ["k"], total="n").collect()
    assert {(r.g, r.k): (r.pos, r.n) for r in got} == {(g, k): (i, len(x)) for g, x in by.items() for i, (k, _) in enumerate(x)}
    down = O.numbered(df, ["g"], [F.col("k").desc()]).collect()
    assert {(r.g, r.k): r.pos for r in down} == {(g, k): len(x) - 1 - i for g, x in by.items() for i, (k, _) in enumerate(x)}
    sums = {(r.g, r.k): r.s for r in O.running_sum(df, ["g"], ["k"], "v", "s").collect()}
    last = {(r.g, r.k): r.f for r in O.filled(df, ["g"], ["k"], "v", "f").collect()}
    for g, x in by.items():
        total, seen = 0.0, None
        for k, v in x:
            assert sums[g, k] == pytest.approx(total)
            seen = seen if v is None else v
            assert last[g, k] == seen
            total += v or 0.0
    for f in (lambda d: O.numbered(d, ["g"], ["k"]), lambda d: O.running_sum(d, ["g"], ["k"], "v", "s"), lambda d: O.filled(d, ["g"], ["k"], "v", "f"), lambda d: O.mean_ranks(d, ["g"], "v", "r")):
        assert f(df.where("false")).count() == 0


def test_mean_ranks(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, v double")
    for r in O.mean_ranks(df, ["g"], "v", "rank").collect():
        v = [x for g, _, x in rows if g == r.g and x is not None]
        assert r["rank"] == (None if r.v is None else sum(x < r.v for x in v) + (sum(x == r.v for x in v) + 1) / 2)


@pytest.mark.parametrize("few", [1, 50, 4096])
def test_quantiles(spark, few):
    draw = random.Random(few)
    wide = lambda: draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300)
    rows = [("wide", wide()) for _ in range(900)] + [("small", 10.0 ** -draw.uniform(0, 200)) for _ in range(700)] + [("few", float(draw.randrange(4))) for _ in range(800)] + [("same", 7.0)] * 300 + [(None, draw.gauss(5, 1)) for _ in range(501)] + [("two", 1.0), ("two", 2.0), ("one", -3.5), ("none", None), ("zero", 0.0), ("zero", -1e-300), ("zero", 1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = {"least": 0.0, "low": 0.05, "mid": 0.5, "q85": 0.85, "q999": 0.999, "most": 1.0}
    linear = {r.g: r for r in Q.quantiles(df, ["g"], "v", at, few=few).collect()}
    places = {r.g: r for r in Q.quantiles(df, ["g"], "v", at, floor=True, few=few).collect()}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert linear[g].n == places[g].n == len(v)
        for name, q in at.items():
            if v:
                assert linear[g][name] == pytest.approx(float(np.quantile(v, q)), rel=1e-9)
                assert places[g][name] == v[min(int(len(v) * q), len(v) - 1)]
            else:
                assert linear[g][name] is None and places[g][name] is None
    assert Q.quantiles(df.where("false"), ["g"], "v", at).count() == 0


def test_plans_have_no_single_task_over_rows(spark, rows):
    """What is planned over rows is dealt by ranges, or by group and bucket."""
    df = spark.createDataFrame(rows, "g string, k int, v double")
    for out in (O.numbered(df, ["g"], ["k"]), O.filled(df, ["g"], ["k"], "v", "f"), Q.quantiles(df, ["g"], "v", {"m": 0.5})):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_same_as_sql(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, v double")
    table = df.toPandas()  # noqa: F841
    want = duckdb.sql("SELECT g, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.97) AS b FROM table GROUP BY g".replace("table", '"table"')).fetchall()
    got = {r.g: (r.a, r.b) for r in Q.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.97}, few=20).collect()}
    for g, a, b in want:
        assert got[g] == pytest.approx((a, b)) if a is not None and a == a else got[g] == (None, None)


def test_tables_of_a_query_are_deleted(spark, rows):
    from pathlib import Path

    from tideline.operators.shared import _made, tidied

    df = spark.createDataFrame(rows, "g string, k int, v double")
    kept = O.numbered(df, ["g"], ["k"])
    before = list(_made)
    with tidied(spark):
        n = O.numbered(df, ["g"], ["k"]).count()
        inside = [p for p in _made if p not in before]
        assert inside and all(Path(p.removeprefix("file:")).exists() for p in inside)
    assert not any(Path(p.removeprefix("file:")).exists() for p in inside) and _made == before and kept.count() == n == len(rows)
