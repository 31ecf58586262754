"""Window and column statistics over long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import filled, mean_ranks
from .quantiles import quantiles
from .shared import cut

# Rows that a rank correlation needs.
LEAST_PAIRS = 5

def latest(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """The newest row of each key; rows whose date is null come last."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))).where("_r = 1").drop("_r")


def pareto(df: DataFrame, by: str, value: str, *tie: str) -> DataFrame:
    """Adds cum, the running sum from the largest value down within `by`, and cum_pct, its share of all."""
    w = Window.partitionBy(by)
    run = w.orderBy(F.desc(value), *tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum", F.sum(value).over(run)).withColumn("cum_pct", 100 * F.col("cum") / F.sum(value).over(w))


def covering_prefix(df: DataFrame, by: str, value: str, pct: float, *tie: str) -> DataFrame:
    """The fewest rows from the largest down whose sum reaches pct per cent."""
    p = pareto(df, by, value, *tie)
    before = F.col("cum_pct") - 100 * F.col(value) / F.sum(value).over(Window.partitionBy(by))
    return p.withColumn("_before", before).where(F.col("_before") < pct).drop("_before")


def market_figures(prices: DataFrame, key: str, at: str, close: str, days: int = 22) -> DataFrame:
    """Of each key's last prices: return over `days`, annual volatility of its changes over them, and the last price's
    fall from the highest of all; needs 10 prices."""
    back = Window.partitionBy(key).orderBy(F.desc(at))
    p = prices.withColumn("_r", F.row_number().over(back)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    p = p.withColumn("_change", F.try_divide(F.col(close), F.lead(close).over(back)) - 1)
    first = F.max(F.when(F.col("_r") == F.least(F.lit(days), F.col("_n")), F.col(close)))
    last = F.max(F.when(F.col("_r") == 1, F.col(close)))
    high = F.max(close)
    return p.groupBy(key).agg(F.max("_n").alias("n"), ((last - first) / first).alias("ret"), (F.stddev_samp(F.when(F.col("_r") <= days, F.col("_change"))) * 252**0.5).alias("vol"), ((high - last) / high).alias("drawdown")).where("n >= 10").drop("n")


def market_cap(prices: DataFrame, shares: DataFrame, key: str, at: str, close: str, days: int = 5) -> DataFrame:
    """(key, close, cap) of each key: the mean of its last `days` closes, and that times its shares (key, shares) in ten
    millions; null where its shares aren't known."""
    last = prices.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where(F.col("_r") <= days)
    return last.groupBy(key).agg(F.avg(close).alias(close)).join(shares, key, "left").select(key, close, (F.col(close) * F.col("shares") / 1e7).alias("cap"))


def log_return_volatility(prices: DataFrame, key: str, at: str, close: str, days: int = 63) -> DataFrame:
    """Annual volatility of the last `days` log returns; needs two prices more."""
    back = Window.partitionBy(key).orderBy(F.desc(at))
    p = prices.withColumn("_r", F.row_number().over(back)).withColumn("_log", F.ln(F.try_divide(F.col(close), F.lead(close).over(back))))
    return p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(F.when(F.col("_r") <= days, F.col("_log"))) * 252**0.5).alias("vol")).where(F.col("n") >= days + 2)


def forward_fill(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return filled(df, [by], [order], value, f"{value}_filled")


def _with_quantiles(df: DataFrame, by: str, value: str, **at: float) -> DataFrame:
    """The rows with quantiles of their group, which go by one row a group."""
    q = quantiles(df, [by], value, at).drop("n").withColumnRenamed(by, "_by")
    return df.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def impute_median(df: DataFrame, by: str, value: str) -> DataFrame:
    return _with_quantiles(df, by, value, _mid=0.5).withColumn(f"{value}_imputed", F.coalesce(value, "_mid")).drop("_mid")


def winsorize(df: DataFrame, by: str, value: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Values cut to two quantiles (linear interpolation) of their group."""
    cut = F.when(F.col(value).isNotNull(), F.greatest("_lo", F.least("_hi", F.col(value))))
    return _with_quantiles(df, by, value, _lo=lo, _hi=hi).withColumn(f"{value}_cut", cut).drop("_lo", "_hi")


def zscore(df: DataFrame, by: str, value: str) -> DataFrame:
    m = df.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(m, by).withColumn(f"{value}_z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def slope(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return df.groupBy(by).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))


def minmax(df: DataFrame, value: str) -> DataFrame:
    """Adds the value scaled to 0 to 1 over all rows, by one aggregate of one row; equal values become 0."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.when(F.col(value).isNotNull(), 0.0))
    return df.join(F.broadcast(ends)).withColumn(f"{value}_scaled", scaled).drop("_lo", "_hi")


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation per group, ties at their mean rank, and how it is read: by its size, or that there are too few rows,
    in which case rho is null."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = mean_ranks(mean_ranks(both, [by], "x", "_x"), [by], "y", "_y")
    found = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))
    few, size = F.col("n") < LEAST_PAIRS, F.abs("rho")
    read = F.when(few, "insufficient data").when(size >= 0.5, "STRONG").when(size >= 0.3, "MODERATE").otherwise("WEAK")
    return found.select(by, "n", F.when(~few, F.col("rho")).alias("rho"), read.alias("signal"))


def describe(df: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.95, 0.97, 0.99, 0.999)) -> DataFrame:
    df = cut(df.select(by, value), "described")  # read by the sums, the sizes and the values
    q = quantiles(df, [by], value, {"median": 0.5} | {f"q{str(p)[2:]}": p for p in at}).drop("n").withColumnRenamed(by, "_by")
    sums = df.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return sums.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def floor_percentile(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The value at place floor(n * share), counted from 0, without interpolation."""
    return quantiles(df, [by], value, {"value": share}, floor=True).where("n > 0").drop("n")


def pivot_first(df: DataFrame, row: str, column: str, value: str, order: str) -> DataFrame:
    """A column per value of `column`, with the first `value` by `order` of each row; a job lists the columns."""
    return df.groupBy(row).pivot(column).agg(F.min_by(value, order))


def top_groups_pivot(df: DataFrame, x: str, group: str, value: str, k: int = 10) -> DataFrame:
    """Sums with a column for each of the k groups of the largest sums, of equals the first by name; one job lists them."""
    sums = df.groupBy(group).agg(F.sum(value).alias("_sum")).where(F.col(group).isNotNull())
    groups = [r[0] for r in sums.orderBy(F.desc("_sum"), group).limit(k).collect()]
    return df.where(F.col(group).isin(groups)).groupBy(x).pivot(group, groups).agg(F.round(F.sum(value), 2))


def long_form(wide: DataFrame, row: str, name: str, value: str) -> DataFrame:
    """A pivot's cells that have a value, one a row."""
    return wide.unpivot(row, [c for c in wide.columns if c != row], name, value).where(F.col(value).isNotNull())
