"""A view of banks with leaves around them: leaves dealt out in turns, links between banks, clusters of risk, dense ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .shared import cut

# Leaves of a bank, and leaves of the capped kind in a view.
LEAVES, CAPPED = 5, 20
#: Banks whose choices of one turn are made together: a task gets at most BLOCK * (BLOCK + 1) rows, of BLOCK banks.
BLOCK = 256


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """The choices of a block of banks, one after the other, each the first of its leaves that is free."""
    taken, out = set(), []
    for bank, own in rows.sort_values(["bank_no", "leaf"]).groupby("bank_no", sort=True):
        for leaf in own["leaf"]:
            if leaf not in taken:
                taken.add(leaf)
                out.append((bank, own["bank"].iloc[0], leaf))
                break
    return pd.DataFrame(out, columns=["bank_no", "bank", "leaf"])


def deal_leaves(candidates: DataFrame, per_bank: int = LEAVES, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """(bank, leaf, turn) from candidates (bank, leaf): in each turn every bank in order takes its first leaf that none has,
    until it has per_bank, or all together have `most`.

    Banks choose in blocks. In a turn a block takes at most `block` leaves, so a bank needs no more than its first that many
    free ones and one, and a task gets these only; what the blocks before have taken is joined away. A turn in which no bank
    finds a leaf is the last. Repeated candidates count once; null banks and leaves are left out."""
    kind = dict(candidates.dtypes)
    base = candidates.select("bank", "leaf").where("bank is not null and leaf is not null").distinct()
    banks = numbered(base.select("bank").distinct().withColumn("_all", F.lit(0)), ["_all"], ["bank"], "bank_no").select("bank", "bank_no")
    free = cut(base.join(banks, "bank"), "candidates")
    blocks = -(-((free.agg(F.max("bank_no")).first()[0] or 0) + 1) // block)
    taken, left = None, most
    for turn in range(1, per_bank + 1):
        got = 0
        for k in range(blocks):
            some = free.where((F.col("bank_no") >= k * block) & (F.col("bank_no") < (k + 1) * block))
            if taken is not None:
                some = some.join(taken.select("leaf"), "leaf", "left_anti")
            # the first leaves of each bank, by an aggregate of bounded size
            first = some.groupBy("bank_no", "bank").agg(F.slice(F.array_sort(F.collect_set("leaf")), 1, block + 1).alias("leaf")).select("bank_no", "bank", F.explode("leaf").alias("leaf"))
            chosen = first.groupBy(F.lit(k).alias("block")).applyInPandas(_choose, f"bank_no long, bank {kind['bank']}, leaf {kind['leaf']}").withColumn("turn", F.lit(turn))
            if left is not None:
                chosen = chosen.orderBy("bank_no").limit(left)
            chosen = cut(chosen, "chosen")
            n = chosen.count()
            got += n
            left = None if left is None else left - n
            taken = chosen if taken is None else taken.unionByName(chosen)
            if left == 0:
                return taken.select("bank", "leaf", "turn")
        if not got:
            break
    return taken.select("bank", "leaf", "turn")


def cap_kind(leaves: DataFrame, capped: Column, limit: int = CAPPED) -> DataFrame:
    """The leaves, of those that `capped` holds for only the `limit` with the least ids."""
    marked = leaves.withColumn("_capped", F.coalesce(capped, F.lit(False)))
    stay = marked.where("_capped").select("leaf").distinct().orderBy("leaf").limit(limit)
    return marked.where("not _capped").unionByName(marked.where("_capped").join(stay, "leaf", "left_semi").select(*marked.columns)).drop("_capped")


def bank_links(edges: DataFrame, banks: DataFrame, leaves: DataFrame, order: str) -> DataFrame:
    """(a, b, type, via) for each pair a < b of the banks (node) that an edge (src, dst, type) leads between, a leaf (bank,
    leaf) counting for the bank that has it. The first edge by `order` counts: one between the banks themselves keeps its
    type, any other is a BANK_NETWORK by way of its type."""
    owner = banks.select("node", F.col("node").alias("owner"), F.lit(True).alias("own")).unionByName(leaves.select(F.col("leaf").alias("node"), F.col("bank").alias("owner"), F.lit(False).alias("own")))
    side = lambda c: owner.select(F.col("node").alias(c), F.col("owner").alias(f"{c}_owner"), F.col("own").alias(f"{c}_own"))
    met = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_owner <> dst_owner")
    first = met.groupBy(F.least("src_owner", "dst_owner").alias("a"), F.greatest("src_owner", "dst_owner").alias("b")).agg(F.min(F.struct(order, "type", (F.col("src_own") & F.col("dst_own")).alias("direct"))).alias("m"))
    return first.select("a", "b", F.when(F.col("m.direct"), F.col("m.type")).otherwise("BANK_NETWORK").alias("type"), F.when(~F.col("m.direct"), F.col("m.type")).alias("via"))


def risk_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, node, members) of nodes (node, kind, grp, risk) and undirected edges (src, dst): nodes at risk of one group,
    with their neighbours that are of that group too, or at risk themselves. Nodes at risk without a group are clusters by
    their kind, and neighbours without one are of their group. A cluster has two members or more."""
    key = F.coalesce("grp", F.concat(F.lit("ungrouped:"), "kind"))
    risky = cut(nodes.where("risk").select("node", "grp", key.alias("cluster")), "risky")
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    other = nodes.select(F.col("node").alias("other"), F.col("grp").alias("other_grp"), F.col("risk").alias("other_risk"))
    near = links.join(risky, "node").join(other, "other").where(F.col("other_grp").eqNullSafe(F.col("grp")) | F.col("other_risk")).select("cluster", F.col("other").alias("node"))
    members = cut(risky.select("cluster", "node").unionByName(near).distinct(), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    return members.join(sizes, "cluster").select("cluster", "node", "members")


def dense_ids(rows: DataFrame, key: str, order: str, name: str = "id", first: int = 1) -> DataFrame:
    """(key, id): the distinct keys numbered without gaps from `first`, in the order in which they first come. Null keys
    have no number."""
    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_order")).withColumn("_all", F.lit(0))
    return numbered(once, ["_all"], ["_order", key], name).select(key, (F.col(name) + first).alias(name))


def graph_of(export: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an export in rows (seq, nodes, relationships): arrays of struct (id, labels, props) and (id, type,
    start_node, end_node, props), with dense ids in the order of nodes and then of the ends of relationships. Of repeated
    ids the last counts. Edges with an end that is no node go."""
    raw_nodes = export.select("seq", F.posexplode("nodes").alias("at", "n")).select(F.struct("seq", "at").alias("o"), "n.*")
    raw_edges = export.select("seq", F.posexplode("relationships").alias("at", "r")).select(F.struct("seq", "at").alias("o"), "r.*")

    def place(kind: int, c: str, end: int) -> list[Column]:
        return [F.struct(F.lit(kind).alias("kind"), F.col("o.seq").alias("seq"), F.col("o.at").alias("at"), F.lit(end).alias("end")).alias("o"), F.col(c).alias("key")]

    seen = raw_nodes.select(*place(0, "id", 0)).unionByName(raw_edges.select(*place(1, "start_node", 0))).unionByName(raw_edges.select(*place(1, "end_node", 1)))
    ids = cut(dense_ids(seen, "key", "o"), "ids")
    last = lambda df, *cs: df.where("id is not null").groupBy(F.col("id").alias("key")).agg(*[F.max_by(c, "o").alias(c) for c in cs])
    nodes = cut(last(raw_nodes, "labels", "props").join(ids, "key").select("id", "key", "labels", "props"), "nodes")
    ends = nodes.select("id", "key")
    edges = last(raw_edges, "type", "start_node", "end_node", "props").withColumnRenamed("key", "edge_id")
    for c, new in (("start_node", "src"), ("end_node", "dst")):
        edges = edges.join(ends.select(F.col("key").alias(c), F.col("id").alias(new)), c)
    return nodes, edges.select("edge_id", "src", "dst", "type", "props")
