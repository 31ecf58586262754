"""Stress that spreads through a network: additive and noisy-OR fixed points as one join and one aggregate a round.

channels is (src, dst, weight, type), nodes (node, base). All rounds read the last one's values only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, sql_round, valid_weight
from .shared import cut, shared_path

ROUNDS, EPSILON = 20, 1e-4
#: Channels of a task in rounds where they stay in place.
TASK_CHANNELS = 4_000_000
#: Noisy-OR weights of links back, and of links of other types.
HOLDER_BACK, LENDER_BACK, LENDER_BACK_MOST, WEAK, HOLDER_PCT, SUBSIDIARY = 0.6, 0.7, 0.6, 0.15, 5.0, 0.5


def additive_channels(lends: DataFrame, rpt: DataFrame, holds: DataFrame) -> DataFrame:
    """From borrowers to lenders (weight absorption or transmittance, times the multipliers), between related parties up
    and down, and from what is held to its owners. lends: bank, company, absorption, transmittance, lgd, t; rpt:
    company, bank, up_weight, down_weight; holds: owner, bank, pct. Ids are of one type. Invalid weights go."""
    parts = [
        lends.select(F.col("company").alias("src"), F.col("bank").alias("dst"), (F.coalesce("absorption", "transmittance") * F.col("lgd") * F.col("t")).alias("weight"), F.lit("LENDS_TO").alias("type")),
        rpt.select(F.col("company").alias("src"), F.col("bank").alias("dst"), F.col("up_weight").alias("weight"), F.lit("RELATED_UP").alias("type")),
        rpt.select(F.col("bank").alias("src"), F.col("company").alias("dst"), F.col("down_weight").alias("weight"), F.lit("RELATED_DOWN").alias("type")),
        holds.select(F.col("bank").alias("src"), F.col("owner").alias("dst"), (F.col("pct") / 100).alias("weight"), F.lit("SHAREHOLDER_OF").alias("type")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.withColumn("weight", valid_weight(F.col("weight"))).where("weight is not null and src <> dst")


def active_channels(channels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Channels with both ends among the nodes."""
    ids = nodes.select("node")
    return channels.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


class Dealt(NamedTuple):
    """Channels in blocks, which stay where they are from round to round: rows (block, src, to) hashed by block, with the
    list `to` of (dst, weight) of a source in a block, and ends (block, src), the blocks that need a source."""

    rows: DataFrame
    ends: DataFrame


def deal(channels: DataFrame) -> Dealt:
    """Channels dealt to ranges of (src, dst), so that what one block adds to a node is mostly summed before it is shuffled,
    and a source with many channels is in several blocks. The rows are kept on the executors' disks, in parts that a join by
    block and source takes as they are; they are to be unpersisted. A lost part is made anew of the written channels."""
    # written first, since ranges are made of a sample and the rows are read twice
    written = cut(channels.select("src", "dst", "weight"), "channels")
    tasks = max(4 * written.sparkSession.sparkContext.defaultParallelism, written.count() // TASK_CHANNELS)
    # more blocks than tasks, so that hashes of blocks fill the tasks evenly
    ranged = written.repartitionByRange(4 * tasks, "src", "dst").withColumn("block", F.spark_partition_id())
    rows = ranged.repartition(tasks, "block").groupBy("block", "src").agg(F.collect_list(F.struct("dst", "weight")).alias("to")).persist(StorageLevel.DISK_ONLY)
    return Dealt(rows, cut(rows.select("block", "src"), "ends"))


@contextmanager
def _in_place(spark: SparkSession) -> Iterator[None]:
    """Joins by block and source take rows that are hashed by block alone as they are; else Spark shuffles both sides by both."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _from(channels: DataFrame | Dealt, source: DataFrame) -> DataFrame:
    """Channels with the columns of their source (src, ...); of dealt ones only the sources are shuffled."""
    if isinstance(channels, DataFrame):
        return channels.join(source, "src")
    met = channels.rows.join(channels.ends.join(source, "src").hint("shuffle_hash"), ["block", "src"])
    return met.select("src", "from", F.explode("to").alias("to")).select("src", "from", "to.dst", "to.weight")


def additive_step(state: DataFrame, channels: DataFrame | Dealt, shocks: DataFrame | None = None, most: float = 1.0) -> DataFrame:
    """state (node, base, x) after one round, and what x was: base plus what comes in, cut at `most`. A shocked source passes
    its shock on in place of its stress."""
    source = state.select(F.col("node").alias("src"), F.col("x").alias("from"))
    if shocks is not None:
        source = source.join(shocks.select(F.col("node").alias("src"), "shock"), "src", "left").select("src", F.coalesce("shock", "from").alias("from"))
    come = _from(channels, source.where("from > 0")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("from")).alias("come"))
    return state.join(come, "node", "left").select("node", "base", clamp(F.col("base") + F.coalesce("come", F.lit(0.0)), 0.0, most).alias("x"), F.col("x").alias("was"))


def noisy_or_step(state: DataFrame, channels: DataFrame | Dealt, shocks: DataFrame | None = None) -> DataFrame:
    """state after one round: one minus the product of all that fails to spread; shocked nodes stay at their shock."""
    source = state.select(F.col("node").alias("src"), F.col("x").alias("from"))
    miss = _from(channels, source).groupBy(F.col("dst").alias("node")).agg(F.product(1 - F.col("weight") * F.col("from")).alias("miss"))
    out = state.join(miss, "node", "left").select("node", "base", clamp(1 - (1 - F.col("base")) * F.coalesce("miss", F.lit(1.0))).alias("x"), F.col("x").alias("was"))
    return out if shocks is None else pinned(out, shocks)


def pinned(state: DataFrame, shocks: DataFrame) -> DataFrame:
    return state.join(shocks.select("node", "shock"), "node", "left").select("node", "base", F.coalesce("shock", "x").alias("x"), "was")


def start(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.coalesce("base", F.lit(0.0)).alias("base")).select("node", "base", F.col("base").alias("x"), F.col("base").alias("was"))


def rounds(nodes: DataFrame, channels: DataFrame, k: int, step=additive_step, shocks: DataFrame | None = None, written: bool = False) -> DataFrame:
    """k rounds without looking at the result. The channels are made once, or are a table already; the rounds are one plan."""
    channels, state = channels if written else cut(channels.select("src", "dst", "weight"), "channels"), start(nodes)
    if shocks is not None and step is noisy_or_step:
        state = pinned(state, shocks)
    for _ in range(k):
        state = step(state, channels, shocks)
    return state.drop("was")


def converge(nodes: DataFrame, channels: DataFrame, step=additive_step, shocks: DataFrame | None = None, most: int = ROUNDS, epsilon: float = EPSILON, trace: bool = False) -> tuple[DataFrame, list[dict]]:
    """Rounds until no node changes by epsilon or more, and what changed in each: round, max_delta, changed, average.

    Each round is written to the shared folder, which cuts the plan and keeps it if an executor is lost. The channels are
    dealt once; a round shuffles values of nodes, not channels. With trace, the frame has all rounds, with their number.
    """
    spark = nodes.sparkSession
    at = shared_path(spark, "rounds")
    state = start(nodes)
    if shocks is not None and step is noisy_or_step:
        state = pinned(state, shocks)
    state.write.parquet(f"{at}/round=0")
    dealt = deal(channels)
    told = []
    with _in_place(spark):
        for k in range(1, most + 1):
            step(spark.read.parquet(f"{at}/round={k - 1}"), dealt, shocks).write.parquet(f"{at}/round={k}")
            gap = F.abs(F.col("x") - F.col("was"))
            row = spark.read.parquet(f"{at}/round={k}").agg(F.max(gap).alias("max_delta"), F.count_if(gap >= epsilon).alias("changed"), F.avg("x").alias("average")).first()
            told.append({"round": k, **row.asDict()})
            if (row["max_delta"] or 0.0) < epsilon:
                break
    dealt.rows.unpersist()
    return (spark.read.parquet(at) if trace else spark.read.parquet(f"{at}/round={told[-1]['round'] if told else 0}")).drop("was"), told


def attribution(state: DataFrame, channels: DataFrame) -> DataFrame:
    """Each channel's part in what its target gained over its base, scaled to the gain where that was cut."""
    source = state.select(F.col("node").alias("src"), F.col("x").alias("from"))
    parts = channels.join(source.where("from > 0"), "src").withColumn("raw", F.col("weight") * F.col("from"))
    total = F.sum("raw").over(Window.partitionBy("dst"))
    gain = state.select(F.col("node").alias("dst"), (F.col("x") - F.col("base")).alias("gain"))
    return parts.withColumn("total", total).join(gain, "dst").select("dst", "src", "type", "raw", (F.col("raw") * F.least(F.lit(1.0), F.try_divide(F.col("gain"), F.col("total")))).alias("contribution"))


def noisy_or_channels(edges: DataFrame, extended: bool = True, distinct: bool = True) -> DataFrame:
    """Channels of edges (edge_id, src, dst, type, pct, up, down, amount). Extended ones also lead back, and weak ones
    stand for edges of other types; the classic set has neither. Each edge is read once for all its channels. Of channels
    with the same ends and edge_id one stays; edges that are distinct need no `distinct`, which shuffles all channels."""
    amount = F.coalesce("amount", F.lit(0.0))
    # written first: a small table is sent to the edges, which are not shuffled for a number of their lender
    total = cut(edges.where("type = 'LENDS_TO'").groupBy(F.col("src").alias("lender")).agg(F.sum(amount).alias("total")), "totals")
    share = clamp(F.coalesce(F.try_divide(amount, F.col("total")), F.lit(0.0)))
    held = clamp(F.coalesce("pct", F.lit(HOLDER_PCT)) / 100)

    def rows(type_: str | None, *links: tuple[bool, Column]) -> DataFrame:
        """The channels of edges of a type, each with its direction (True leads back) and weight."""
        some = edges.where(F.col("type") == type_) if type_ else edges.where(~F.col("type").isin("SHAREHOLDER_OF", "SUBSIDIARY_OF", "LENDS_TO"))
        if type_ == "LENDS_TO":
            some = some.join(total, F.col("src").eqNullSafe(F.col("lender")))
        some = some.select("src", "dst", "edge_id", F.inline(F.array(*[F.struct(F.lit(back).alias("back"), clamp(w).alias("weight")) for back, w in links])))
        return some.select(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "edge_id", F.lit(type_ or "LENDS_TO").alias("type"), "weight")

    more = lambda back, w: [(back, w)] if extended else []
    every = rows("SHAREHOLDER_OF", (True, held), *more(False, held * HOLDER_BACK))
    every = every.unionByName(rows("SUBSIDIARY_OF", (False, F.coalesce("up", F.lit(SUBSIDIARY))), (True, F.coalesce("down", F.lit(SUBSIDIARY)))))
    every = every.unionByName(rows("LENDS_TO", (True, share), *more(False, F.least(share * LENDER_BACK, F.lit(LENDER_BACK_MOST)))))
    if extended:
        every = every.unionByName(rows(None, (False, F.lit(WEAK)), (True, F.lit(WEAK))))
    return every.dropDuplicates(["src", "dst", "edge_id"]) if distinct else every


def base_stress(label: Column, stress: Column, bank_score: Column, company_score: Column) -> Column:
    """The first known score: the node's own, a bank's, a company's; over 1 it is in percent; unknown is 0."""
    raw = F.coalesce(stress, F.when(label.isin("Bank", "CommercialBank"), bank_score), F.when(label == "Company", company_score))
    return F.coalesce(clamp(F.when(raw > 1, raw / 100).otherwise(raw)), F.lit(0.0))


def top_contributors(state: DataFrame, channels: DataFrame, k: int = 3) -> DataFrame:
    """The k largest contributions to each node, compared at nine places as SQL rounds; of equals the first by source."""
    source = state.select(F.col("node").alias("src"), F.col("x").alias("from"))
    c = channels.join(source, "src").withColumn("contribution", F.col("weight") * F.col("from")).where("contribution > 0")
    r = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc(sql_round(F.col("contribution"), 9)), "src", "type"))
    return c.withColumn("rank", r).where(F.col("rank") <= k).select("dst", "rank", "src", "type", "contribution")


def impacted(state: DataFrame, least: float = 1e-3, limit: int = 20) -> DataFrame:
    """Nodes that gained more than `least`, the largest gains first."""
    gain = F.round(F.col("x") - F.col("base"), 6)
    return state.select("node", "base", "x", gain.alias("gain")).where(F.col("gain") > least).orderBy(F.desc("gain"), "node").limit(limit)
