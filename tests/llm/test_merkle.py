"""The Merkle manifest against a plain tree, and on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def told(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """(root, path of every node)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = at - at % fanout
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
            where[k] = at // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout):
    """(id, group, leaf) to [(id, group, leaf, subroot, root, path)], sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    made = {g: tree([r[2] for r in groups[g]], fanout) for g in order}
    root, upper = tree([made[g][0] for g in order], fanout)
    return sorted((str(r[0]), str(g), r[2], made[g][0], root, made[g][1][k] + upper[j]) for j, g in enumerate(order) for k, r in enumerate(groups[g]))


def got(df, fanout=2, levels=8):
    out = merkle.manifest(df, fanout=fanout, levels=levels).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert all(r.folded == r.root and r.proof == H(*[x for s in r.path for x in s]) for r in out)
    return sorted((str(r.doc_id), str(r.lang), r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in out)


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 2, 1), (2, 2, 2), (2, 2, 3), (2, 3, 300), (3, 2, 200), (2, 8, 257), (4, 1, 90)])
def test_any_size_and_fanout(spark, fanout, levels, n):
    draw = random.Random(n)
    rows = [(i, draw.choice(["a", "a", "a", "a", "b", "é", "z", None, ""]), H(str(i))) for i in draw.sample(range(10 * n), n)]
    assert got(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"), fanout, levels) == plain(rows, fanout)


def test_one_group_and_one_leaf(spark):
    rows = [(7, None, H("x"))]
    assert got(spark.createDataFrame(rows, "doc_id long, lang string, leaf string")) == [("7", "None", H("x"), H("x"), H("x"), [])]


def test_odd_rows(spark):
    """Null ids, repeated rows, null in every column, long texts, clashing names; an empty table."""
    docs = [(None, None, None, None, None), (None, "s", None, 3, "abc"), (5, "s", "en", 3, ""), (5, "s", "en", 3, ""), (6, "é:", "en", None, "x" * 300_000), (4, "s", "en", 0, None), (8, "s", "", 0, "日本")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    leaf = merkle.leaf_hash([F.col(c) for c in df.columns])
    clash = ["g", "n", "pos", "row", "rows", "tie", "block", "levels", "path", "root", "subroot", "node", "id"]
    made = df.select("doc_id", "lang", leaf.alias("leaf"), *[F.lit("clash").alias(c) for c in clash])
    rows = [(d[0], d[2], told(d)) for d in docs]
    assert got(made) == plain(rows, 2)
    assert {"g", "row", "tie"} <= set(merkle.manifest(made).columns) and merkle.manifest(made).where("g = 'clash'").count() == len(docs)
    assert merkle.manifest(made.where("false")).count() == 0


def test_any_change_leads_elsewhere(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    made = merkle.manifest(df)
    other = made.withColumn("folded", merkle.fold(F.sha2(F.concat("leaf", F.lit("!")), 256), F.col("path")))
    assert other.where("folded = root").count() == 0 and other.select("root").distinct().count() == 1
