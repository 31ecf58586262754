"""Order-dependent columns of groups of any size: places, running sums, mean ranks and filled gaps.

Rows are dealt to ranges of (group, order). What a row needs of the rows before it is what its own range has of them,
and one number for each earlier range of the group. So no task holds a whole group, and no window holds more than a
range, or one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

_FIRST = Window.unboundedPreceding


def _placed(rows: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """The rows, written in ranges of (group, order), with their place among all (_at) and their range (_range). They are
    written first, since ranges are made of a sample and the rows are read twice."""
    base = cut(rows, "rows")
    placed = cut(base.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    return placed.withColumn("_range", F.shiftright("_at", 33))


def _with_ranges(placed: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """The rows with the columns of their range; ranges has as many rows as ranges and groups together."""
    named = ranges.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_range").alias("_r"), *[c for c in ranges.columns if c not in (*group, "_range")])
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(named, same)


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "pos", total: str | None = None) -> DataFrame:
    """The rows with their place (from 0) in the order of their group, and in `total` how many rows it has. Nulls are a
    group too. Rows that tie in all of `order` are numbered as they come; an empty table gives no rows."""
    placed = _placed(rows, group, order)
    whole = Window.partitionBy(*group)
    ranges = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(_FIRST, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).withColumn("_total", F.sum("_rows").over(whole)).drop("_rows")
    more = [F.col("_total").alias(total)] if total else []
    return _with_ranges(placed, ranges, group).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_start")).alias(name), *more)


def running_sum(rows: DataFrame, group: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """The rows with the sum of `value` over the rows before them in their group, 0 for the first. Nulls add nothing."""
    placed = _placed(rows, group, order)
    ranges = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(_FIRST, -1)), F.lit(0))).drop("_sum")
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(_FIRST, -1)), F.lit(0))
    return _with_ranges(placed.withColumn("_within", within), ranges, group).select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))


def filled(rows: DataFrame, group: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """The rows with the last value that isn't null up to them in their group."""
    placed = _placed(rows, group, order)
    ranges = placed.groupBy(*group, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last"))
    ranges = ranges.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_range").rowsBetween(_FIRST, -1))).drop("_last")
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(_FIRST, 0))
    return _with_ranges(placed.withColumn("_within", within), ranges, group).select(*rows.columns, F.coalesce("_within", "_before").alias(name))


def mean_ranks(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """The rows with the rank of their value in their group from 1, of equal values their mean rank; null for null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_sum(counts, group, [value], "_n", "_less").select(*[F.col(g).alias(f"_k{k}") for k, g in enumerate(group)], F.col(value).alias("_v"), (F.col("_less") + (F.col("_n") + 1) / 2).alias(name))
    same = F.col(value) == F.col("_v")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_k{k}"))
    return rows.join(ranks, same, "left").select(*rows.columns, name)
