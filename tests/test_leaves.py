"""Leaves, clusters, links and dense ids against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import leaves as L


def plain_leaves(candidates, per_bank, most):
    banks = sorted({b for b, _ in candidates})
    own = {b: sorted({x for c, x in candidates if c == b}) for b in banks}
    taken, used, out, turn = set(), dict.fromkeys(banks, 0), [], 0
    while most is None or len(taken) < most:
        turn, moved = turn + 1, False
        for b in banks:
            if most is not None and len(taken) >= most:
                break
            free = next((x for x in own[b] if x not in taken), None) if used[b] < per_bank else None
            if free is not None:
                taken.add(free)
                used[b] += 1
                out.append((b, free, turn))
                moved = True
        if not moved:
            break
    return sorted(out)


@pytest.mark.parametrize(("seed", "per_bank", "most", "block"), [(1, 3, None, 256), (2, 3, 11, 3), (3, 2, None, 2), (4, 2, 1, 2), (5, 2, 14, 4)])
def test_leaves_in_turns(spark, seed, per_bank, most, block):
    draw = random.Random(seed)
    candidates = [(f"b{draw.randrange(9)}", draw.randrange(30)) for _ in range(draw.choice([40, 90]))]
    df = spark.createDataFrame([*candidates, (None, 3), ("b1", None)], "bank string, leaf int")
    assert sorted(map(tuple, L.deal_leaves(df, per_bank, most, block).collect())) == plain_leaves(candidates, per_bank, most)


def test_no_candidates_and_capped_kinds(spark):
    df = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 5), ("b2", 4)], "bank string, leaf int")
    assert L.deal_leaves(df.where("false")).count() == 0
    kept = L.cap_kind(df, F.col("leaf") >= 2, 2).collect()
    assert sorted(r.leaf for r in kept) == [1, 2, 4]
    assert L.cap_kind(df, F.lit(None).cast("boolean"), 0).count() == 4


def test_links_between_banks(spark):
    edges = [(1, "b1", "x", "LENDS_TO"), (2, "x", "b2", "RPT"), (3, "b1", "b2", "HOLDS"), (4, "b2", "b3", "HOLDS"), (5, "x", "y", "LENDS_TO"), (6, "z", "b1", "LENDS_TO"), (7, "b3", "b2", "RPT")]
    df = spark.createDataFrame(edges, "seq int, src string, dst string, type string")
    banks = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "node string")
    leaves = spark.createDataFrame([("b1", "x"), ("b3", "y")], "bank string, leaf string")
    assert sorted(map(str, (tuple(r) for r in L.bank_links(df, banks, leaves, "seq").collect()))) == sorted(map(str, [("b1", "b2", "BANK_NETWORK", "RPT"), ("b2", "b3", "HOLDS", None), ("b1", "b3", "BANK_NETWORK", "LENDS_TO")]))


def test_clusters(spark):
    draw = random.Random(6)
    nodes = [(k, draw.choice(["Bank", "Company"]), draw.choice(["g1", "g2", "g3", None]), draw.random() < 0.3) for k in range(60)] + [(99, "Bank", "alone", True)]
    edges = [(draw.randrange(60), draw.randrange(62)) for _ in range(120)]
    of = {n[0]: n for n in nodes}
    want = {}
    for n, kind, grp, risk in nodes:
        if risk:
            own = want.setdefault(grp or f"ungrouped:{kind}", set())
            own.add(n)
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == n and y in of and (of[y][2] == grp or of[y][3]):
                        own.add(y)
    got = {}
    for r in L.risk_clusters(spark.createDataFrame(nodes, "node int, kind string, grp string, risk boolean"), spark.createDataFrame(edges, "src int, dst int")).collect():
        got.setdefault(r.cluster, set()).add(r.node)
        assert r.members == len(want[r.cluster])
    assert got == {k: v for k, v in want.items() if len(v) >= 2}


def test_dense_ids(spark):
    draw = random.Random(8)
    rows = [(draw.choice("abcdefghijk") + str(draw.randrange(40)), k) for k in range(900)] + [(None, 5)]
    order = {}
    for key, _ in rows:
        if key is not None:
            order.setdefault(key, len(order) + 1)
    df = spark.createDataFrame(rows, "key string, k int").repartition(9)
    out = L.dense_ids(df, "key", "k")
    assert {r.key: r.id for r in out.collect()} == order and "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_graph_of_an_export(spark, tmp_path):
    from tideline.sources.files import read_json

    (tmp_path / "g.json").write_text('{"nodes": [{"id": "n7", "labels": ["Bank"], "props": {"name": "A"}}, {"id": "n3", "labels": [], "props": {}}, {"id": "n7", "labels": ["Bank"], "props": {"name": "B"}}, {"id": null, "labels": [], "props": {}}], "relationships": [{"id": "r1", "type": "T", "start_node": "n3", "end_node": "n7", "props": {}}, {"id": "r2", "type": "T", "start_node": "gone", "end_node": "n3", "props": {}}, {"id": "r1", "type": "U", "start_node": "n7", "end_node": "n3", "props": {}}]}')
    props = "map<string,string>"
    schema = f"nodes array<struct<id:string,labels:array<string>,props:{props}>>, relationships array<struct<id:string,type:string,start_node:string,end_node:string,props:{props}>>"
    nodes, edges = L.graph_of(read_json(spark, str(tmp_path / "g.json"), schema).withColumn("seq", F.lit(0)))
    assert sorted((r.id, r.key, r.props) for r in nodes.collect()) == [(1, "n7", {"name": "B"}), (2, "n3", {})]
    assert [(r.edge_id, r.src, r.dst, r.type) for r in edges.collect()] == [("r1", 1, 2, "U")]
