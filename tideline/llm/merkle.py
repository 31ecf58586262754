"""A manifest of a dataset as Merkle trees: one for each group of rows, and one over the groups' roots.

Leaves are numbered in order within their group, gathered in blocks of consecutive ones, and each block's levels are
collapsed by higher-order functions over its array. The roots of blocks are the leaves of the next round, so a group of
any size takes as many rounds as its size has digits in base FANOUT ** LEVELS. Paths then go down the same blocks.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered

#: Nodes that are hashed to one, and levels of a block: it has FANOUT ** LEVELS nodes at most.
FANOUT, LEVELS = 2, 8
_PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(columns: list[Column]) -> Column:
    """The hash of a row's values: `-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by a path."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def _count_to(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _levels(nodes: Column, depth: Column, fanout: int) -> Column:
    """The nodes of a block, level by level up to its root."""

    def up(below: Column) -> Column:
        return F.transform(_count_to(F.ceil(F.size(below) / fanout)), lambda j: digest(F.array_join(F.slice(below, j * fanout + 1, F.lit(fanout)), "")))

    return F.aggregate(_count_to(depth), F.array(nodes), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, -1)))))


def _siblings(levels: Column, i: Column, fanout: int, deepest: int) -> Column:
    """The path of a block's i-th node within the block."""
    powers = F.array(*[F.lit(fanout**k) for k in range(deepest)])

    def at(level: Column) -> Column:
        place = F.floor(i / F.get(powers, level)).cast("int")
        start = place - place % fanout
        row = F.get(levels, level)
        before = F.array_join(F.slice(row, start + 1, place - start), "")
        after = F.array_join(F.slice(row, place + 2, start + fanout - place - 1), "")
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(_count_to(F.size(levels) - 1), at)


def _rounds(nodes: DataFrame, fanout: int, levels: int, scratch: Scratch) -> list[DataFrame]:
    """From nodes (g, n, pos, node, row), the blocks (g, n, block, rows, levels) of each round; the last one's are the
    roots of the groups."""
    size, out = fanout**levels, []
    while True:
        depth = sum((F.when(F.col("n") > fanout**k, 1).otherwise(0) for k in range(levels)), F.lit(0))
        gathered = nodes.groupBy("g", "n", F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node", "row"))).alias("rows"))
        out.append(scratch.table(gathered.withColumn("levels", _levels(F.col("rows.node"), depth, fanout)), "blocks"))
        if out[-1].where(F.col("n") > size).isEmpty():
            return out
        nodes = out[-1].select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), _root("levels").alias("node"), F.lit(None).cast("int").alias("row"))


def _root(levels: str) -> Column:
    return F.get(F.element_at(levels, -1), F.lit(0))


def _down(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """From `top` (g, path, and other columns of a group), (g, pos, row, path, those columns) of the first round's nodes."""
    more = [c for c in top.columns if c not in ("g", "path")]
    upper = top.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        on = [F.col("b.g") == F.col("u.g"), F.col("b.block") == F.col("u.pos")]
        joined = blocks.alias("b").join(upper.alias("u"), on).select("b.g", "b.rows", "b.levels", F.col("u.path").alias("path"), *[f"u.{c}" for c in more])
        each = F.transform("rows", lambda r, i: F.struct(r["pos"].alias("pos"), r["row"].alias("row"), F.concat(_siblings(F.col("levels"), i, fanout, levels), F.col("path")).alias("path")))
        upper = joined.select("g", *more, F.explode(each).alias("r")).select("g", *more, "r.pos", "r.row", "r.path")
    return upper


def manifest(leaves: DataFrame, group_col: str = "lang", id_col: str = "doc_id", leaf_col: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The rows with all their columns and subroot, root and path (from leaf to root, the texts of the siblings before
    and after the node at each level).

    Of each group the leaves ascend by id, null first, then by leaf; while several nodes remain, every `fanout`
    consecutive ones become the hash of their texts, fewer at the end, even one. What remains, for one leaf that leaf, is
    the group's subroot. Subroots in order of their groups, null first, then by UTF-8 bytes, give the root likewise.
    Repeated rows are leaves of their own. Columns named subroot, root or path are replaced; a null leaf is an error that
    the caller avoids by `leaf_hash`. An empty table gives no rows.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    g = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    row = F.struct(*[F.col(c) for c in kept])
    base = scratch.table(leaves.select(g.alias("g"), F.col(id_col).alias("id"), F.col(leaf_col).alias("node"), row.alias("row"), F.monotonically_increasing_id().alias("tie")), "leaves")
    rounds = _rounds(numbered(base, ["g"], ["id", "node", "tie"], scratch), fanout, levels, scratch)
    subroots = scratch.table(rounds[-1].select("g", _root("levels").alias("subroot")), "subroots")
    heads = numbered(subroots.select(F.lit("").alias("all"), "g", "subroot"), ["all"], ["g"], scratch)
    upper = _rounds(heads.select(F.lit("").alias("g"), "n", "pos", F.col("subroot").alias("node"), F.struct("g", "subroot").alias("row")), fanout, levels, scratch)
    top = upper[-1].select("g", F.array().cast(_PATH).alias("path"), _root("levels").alias("root"))
    groups = scratch.table(_down(upper, top, fanout, levels).select(F.col("row.g").alias("g"), F.col("row.subroot").alias("subroot"), "root", "path"), "groups")
    return _down(rounds, groups, fanout, levels).select("row.*", "subroot", "root", "path")
