"""Sources of companies, resolution's trace, sinks, and the older bank model against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import companies as C
from tideline.operators import matching as M
from tideline.sources import files


def test_consolidation_keeps_each_company_once(spark):
    frame = spark.createDataFrame
    out = C.consolidate(frame([("a", "X", 1), (" A ", "", 2), (None, None, 3), ("", "y", 4), ("b", "Z", 5)], "code string, symbol string, k int"), frame([("A", "c1"), ("a", "c0"), ("", "c9"), (None, "c8"), ("b", "none")], "code string, cin string"), frame([("C1", "ok"), ("c1", "also"), ("", "no")], "cin string, status string"), frame([("x", 5), ("X ", 7), ("", 1)], "symbol string, shares int"))
    assert sorted((r.k, r.cin, r.status, r.shares) for r in out.collect()) == [(1, "c1", "ok", 7), (2, "c1", "ok", None), (3, None, None, None), (4, None, None, None), (5, "none", None, None)]
    named = C.by_crosswalk(frame([("Axis Bank Ltd.",), ("Other",), (None,)], "n string"), "n", frame([("AXIS BANK LIMITED", "AXB"), ("Axis Bank", "AXA")], "known string, symbol string")).collect()
    assert {r.n: r.symbol for r in named} == {"Axis Bank Ltd.": "AXA", "Other": None, None: None}


def test_trace_of_resolution(spark):
    frame = spark.createDataFrame
    banks, companies = frame([("b1", "Sun Bank"), ("b1", "SUN")], "entity string, known string"), frame([("c1", "Sun Bank"), ("c2", "Moon Power Ltd")], "entity string, known string")
    out = {r.n: [(h["pass"], h.entity) for h in r.trace] for r in M.resolve(frame([("Sun Bank",), ("SUN",), ("Moon Powers",), ("odd",), (None,)], "n string"), "n", banks, companies, trace=True).collect()}
    assert out == {"Sun Bank": [(1, "b1"), (2, "c1")], "SUN": [(1, "b1"), (4, "b1")], "Moon Powers": [(3, "c2")], "odd": [], None: []}


def test_a_bank_by_its_name_as_it_stands(spark):
    frame = spark.createDataFrame
    banks = frame([("b1", "Sun Bank"), ("b2", "Sun Bank Ltd"), ("b3", "Ltd")], "entity string, known string")
    out = M.resolve(frame([("SUN BANK",), (" sun bank ltd",), ("Sun Bank Limited",), ("ltd",)], "n string"), "n", banks, frame([("c1", "x y")], "entity string, known string"))
    assert {r.n: r.entity for r in out.collect()} == {"SUN BANK": "b1", " sun bank ltd": "b2", "Sun Bank Limited": "b2", "ltd": "b3"}


def test_documents_by_bank(spark, tmp_path):
    (tmp_path / "basel_AXIS.json").write_text('{"car": 15.5}')
    (tmp_path / "axis_basel.json").write_text('{"car": 1.0}')
    (tmp_path / "hdfc_basel.json").write_text('{"car": 16.0}')
    (tmp_path / "basel_all_banks.json").write_text('{"sbi": {"car": 13.0}, "AXIS": {"car": 9.0}}')
    banks = spark.createDataFrame([("AXIS",), ("HDFC",), ("SBI",), ("GONE",)], "symbol string")
    got = {r.symbol: (r.found, r.doc and r.doc.car) for r in files.read_by_bank(spark, str(tmp_path), banks, "car double", "basel").collect()}
    assert got == {"AXIS": ("basel_AXIS.json", 15.5), "HDFC": ("hdfc_basel.json", 16.0), "SBI": ("basel_all_banks.json", 13.0), "GONE": (None, None)}


def test_sinks_and_purge(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_json(df, str(tmp_path / "out"), model="m", year=2025)
    assert files.read_meta(spark, str(tmp_path / "out")) == {"model": "m", "rows": 2, "year": 2025}
    assert spark.read.schema("k int, v string").json(str(tmp_path / "out" / "rows")).count() == 2
    assert files.console_table(df, 1) == "k | v\n--+--\n1 | a\n...\n" and files.console_table(df.where("false")) == "k | v\n--+--\n"
    nodes = spark.createDataFrame([("a", ["Bank"]), ("b", ["Company", "X"]), ("c", None)], "node string, labels array<string>")
    edges = spark.createDataFrame([("a", "b", 1), ("c", "a", 2), ("c", "c", 3)], "src string, dst string, w int")
    left, kept = files.purge(nodes, edges, "Company")
    assert sorted(r.node for r in left.collect()) == ["a", "c"] and sorted(r.w for r in kept.collect()) == [2, 3]
    left, kept = files.purge(nodes, edges)
    assert left.count() == kept.count() == 0


def test_panel_stress_same_as_numpy(spark):
    rng = np.random.default_rng(3)
    names, years, banks = {"npa": 1, "car": -1, "roa": -1}, (2021, 2022, 2023), range(25)
    data = {(b, y): [None if rng.random() < 0.15 else float(v) for v in rng.normal(b % 5, 2, 3)] for b in banks for y in years if not (b == 3 and y == 2023) and not (b == 4 and y < 2023)}
    df = spark.createDataFrame([(b, y, *v) for (b, y), v in data.items()], "bank int, year int, npa double, car double, roa double")
    z = {}
    for y in years:
        ids = [b for b in banks if (b, y) in data]
        for k, sign in enumerate(names.values()):
            col = [data[b, y][k] for b in ids]
            mid = np.median([c for c in col if c is not None])
            x = np.array([mid if c is None else c for c in col])
            x = np.clip(x, *np.quantile(x, [0.05, 0.95]))
            for b, v in zip(ids, sign * (x - x.mean()) / x.std(), strict=True):
                z[b, y, k] = v
    last = [b for b in banks if (b, 2023) in data]
    slope = lambda b, k: np.polyfit([y for y in years if (b, y) in data], [z[b, y, k] for y in years if (b, y) in data], 1)[0] if sum((b, y) in data for y in years) > 1 else 0.0
    m = np.array([[z[b, 2023, k] for k in range(3)] + [slope(b, k) for k in range(3)] for b in last])
    m = (m - m.mean(0)) / m.std(0)
    first = np.linalg.svd(m, full_matrices=False)[2][0]
    score = m @ (first * (1 if first[0] >= 0 else -1))
    want = (score - score.min()) / (score.max() - score.min())
    got = {r.bank: r.score for r in C.panel_stress(df, "bank", "year", names, "npa").collect()}
    assert sorted(got) == last and [got[b] for b in last] == pytest.approx(list(want), abs=1e-6)


def test_counters(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), (None, 2.0), ("b", None)], "g string, v double")
    got = {(r.whole, r.g): (r.n, r.least, r.most, r["mean"], r.median, r.flagged) for r in C.counters(df, "g", "v", F.col("v") > 1).collect()}
    assert got == {(False, "a"): (2, 1.0, 4.0, 2.5, 2.5, 1), (False, None): (1, 2.0, 2.0, 2.0, 2.0, 1), (False, "b"): (1, None, None, None, None, 0), (True, None): (4, 1.0, 4.0, pytest.approx(7 / 3), 2.0, 2)}


def test_panel_is_written_between_metrics(spark, monkeypatch):
    """The rows of a later metric are a table, not the joins of those before."""
    plans, real = [], C.impute_median

    def seen(rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        if len(plans) == 2:
            raise StopIteration
        return real(rows, *args)

    monkeypatch.setattr(C, "impute_median", seen)
    df = spark.createDataFrame([(b, y, float(b * y), float(b)) for b in range(4) for y in (1, 2)], "bank long, year long, p double, q double")
    with pytest.raises(StopIteration):
        C.panel_stress(df, "bank", "year", {"p": 1, "q": 1}, "p")
    assert all("Relation" in p and "Join" not in p for p in plans)
