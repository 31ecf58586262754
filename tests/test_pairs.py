"""Pairs of banks by what they share, against plain loops, and what their plans shuffle."""

from collections import Counter
from itertools import combinations

from tideline.operators import graph_queries as G
from tideline.operators import traversal as V

LENDS = [(b, c, float(10 * b + c), 1) for c in range(40) for b in range(c % 7, 12, 1 + c % 3)] + [(1, None, 1.0, 1), (None, 2, 1.0, 1), (5, 99, 3.0, 1)]
RPT = [(c, b, 1.0, 0.0, n) for c in range(40) for b, n in ((c % 12, 1 + c % 4), ((c + 5) % 12, 2))]


def frames(spark):
    return spark.createDataFrame(LENDS, "bank long, company long, amount double, n long"), spark.createDataFrame(RPT, "company long, bank long, amount double, up double, n long")


def shared():
    of = {}
    for b, c, x, _ in LENDS:
        if b is not None and c is not None:
            of.setdefault(c, []).append((b, x))
    return [(*sorted((p, q)),) for rows in of.values() for p, q in combinations(rows, 2) if p[0] != q[0]]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_bank_network_same_as_loop(spark):
    lends, _ = frames(spark)
    n, least = Counter(), Counter()
    for (a, x), (b, y) in shared():
        n[a, b] += 1
        least[a, b] += min(x, y)
    df = V.bank_network(lends)
    assert {(r.a, r.b): (r.shared, r.overlap) for r in df.collect()} == {k: (n[k], least[k]) for k in n}
    plan, _ = shuffles(df)
    assert "rangepartitioning(company" in plan and "Join" not in plan


def test_bank_cluster_same_as_loop(spark):
    lends, _ = frames(spark)
    df = G.bank_cluster(lends.unionByName(lends.limit(3)))  # a company counts once
    assert {(r.a, r.b): r.shared for r in df.collect()} == Counter((a, b) for (a, _), (b, _) in shared())
    assert "rangepartitioning(company" in shuffles(df)[0]


def test_bridge_shuffles_no_pairs(spark):
    lends, rpt = frames(spark)
    want = Counter()
    for b, c, _, _ in LENDS:
        for c2, b2, _, _, n in RPT:
            if b is not None and c == c2 and b != b2:
                want[b, b2, c] += n
    df = G.related_bridge(lends, rpt, 1000)
    assert {(r.lending_bank, r.rpt_bank, r.company): r.rpt_count for r in df.collect()} == want
    assert not [x for x in shuffles(df)[1] if "rpt_bank" in x and "bank#" in x.split("rpt_bank")[0]]


def test_views_pair_by_ranges(spark):
    from tideline.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for df, key in ((t.bank_rpt, "l_partkey"), (t.bank_holds, "l_orderkey")):
        assert f"rangepartitioning({key}" in shuffles(df)[0]


def test_industries_and_lenders_keep_no_sets(spark):
    """Companies and lenders are counted without distinct sets, also where edges or industries repeat."""
    lends, _ = frames(spark)
    lends = lends.where("bank is not null").unionByName(lends.limit(3))
    industry = spark.createDataFrame([(c, "n", f"i{c % 3}", 1) for c in range(40)] + [(3, "n", "i0", 1), (3, "n", "i1", 1)], "company long, name string, industry string, nation int")
    rows = [(b, f"i{c % 3}", c, x, c) for b, c, x, _ in LENDS + LENDS[:3] if b is not None and c is not None and c < 40]
    rows += [(b, i, c, x, c) for b, c, x, _ in LENDS + LENDS[:3] if b is not None and c == 3 for i in ("i0", "i1")]
    total, kinds = Counter(), {}
    for b, i, c, x, _ in rows:
        total[b, i] += x
        kinds.setdefault((b, i), set()).add(c)
    df = G.industry_exposure(lends, industry)
    assert {(r.bank, r.industry): (r.exposure, r.num_companies) for r in df.collect()} == {k: (total[k], len(kinds[k])) for k in total}
    assert "distinct" not in shuffles(df)[0]
    df = G.dual_borrowers(lends, industry.where("nation = 1"), 10000)
    assert "distinct" not in shuffles(df)[0] and "collect_set" not in shuffles(df)[0]
    lenders = {}
    for b, c, _, _ in LENDS:
        if b is not None:
            lenders.setdefault(c, set()).add(b)
    assert {r.company for r in df.collect()} == {c for c, bs in lenders.items() if c is not None and c < 40 and len(bs) > 1}


def test_bank_network_shuffles_no_pairs(spark, monkeypatch):
    """Lists go to the task of the lower bank, and as many tasks as the pairs need sum them; no sums are made before."""
    monkeypatch.setattr(G, "TASK_PAIRS", 50)
    lends, _ = frames(spark)
    df = V.bank_network(lends)
    plan, hashed = shuffles(df)
    assert len(hashed) == 1 and "REPARTITION_BY_NUM" in hashed[0] and "b#" not in hashed[0]
    pairs = len(shared())
    assert pairs // 50 <= int(hashed[0].split("), REPARTITION")[0].split(", ")[-1]) <= pairs // 50 + 20
    assert {(r.a, r.b): r.shared for r in df.collect()} == Counter((a, b) for (a, _), (b, _) in shared())


def test_bank_network_of_odd_numbers(spark):
    """Amounts and banks beyond four bytes, unknown amounts, and a bank that a company has twice."""
    rows = [(1, 1, 0.1), (2, 1, 1e10 + 0.5), (3, 1, 2.0), (1, 2, 3.0), (2**40, 2, 4.0), (-5, 2, None), (1, 3, 7.0), (1, 3, 9.0), (2, 3, 8.0), (3, 4, None), (4, 4, None), (2, 5, float(2**24 + 1)), (3, 5, 2.0**25)]
    n, least = Counter(), {}
    for k, (b, c, x) in enumerate(rows):
        for b2, c2, y in rows[k + 1 :]:
            if c == c2 and b != b2:
                key, known = tuple(sorted((b, b2))), [v for v in (x, y) if v is not None]
                n[key] += 1
                least[key] = least.get(key, 0.0) + min(known) if known else None
    df = V.bank_network(spark.createDataFrame(rows, "bank long, company long, amount double"))
    assert {(r.a, r.b): (r.shared, r.overlap) for r in df.collect()} == {k: (n[k], None if least[k] is None else round(least[k], 2)) for k in n}


def test_bank_cluster_shuffles_no_pairs(spark, monkeypatch):
    """As bank_network; companies and banks count once."""
    monkeypatch.setattr(G, "TASK_PAIRS", 50)
    lends, _ = frames(spark)
    df = G.bank_cluster(lends.unionByName(lends))
    hashed = shuffles(df)[1]
    assert len(hashed) == 1 and "REPARTITION_BY_NUM" in hashed[0] and "b#" not in hashed[0]
    assert {(r.a, r.b): r.shared for r in df.collect()} == Counter((a, b) for (a, _), (b, _) in shared())
