"""Series and panel statistics over events, orders and items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import stats as W
from ..operators.companies import panel_stress
from .views import Tables, sql


def prices(t: Tables):
    """A close of each event type for every six hours: the mean value, cut to thousandths. It is made of whole numbers,
    so that it doesn't depend on their order."""
    six = F.floor(F.unix_timestamp("ts") / 21600).alias("slot")
    x = t["events"].select(F.col("event_type").alias("key"), six, F.floor(F.col("value") * 1000 + 0.5).alias("x"))
    return x.groupBy("key", "slot").agg((F.expr("sum(x) div nullif(count(x), 0)") / 1000).alias("close"))


def panel(t: Tables):
    """A year's items of each bank: (year, bank, n, q)."""
    return t["lineitem"].groupBy(F.year("l_shipdate").cast("long").alias("year"), F.col("l_suppkey").alias("bank")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).withColumn("x", F.when(F.col("bank") % 4 != 0, F.col("q")))


_PRICES = "SELECT key, slot, CAST(CAST(sum(x) AS BIGINT) // nullif(count(x), 0) AS DOUBLE) / 1000 AS close FROM (SELECT event_type AS key, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS x FROM events) GROUP BY ALL"
_BACK = f"WITH p AS ({_PRICES}), b AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY key) AS n, close / lead(close) OVER w - 1 AS change, ln(close / lead(close) OVER w) AS logr FROM p WINDOW w AS (PARTITION BY key ORDER BY slot DESC))"
_PANEL = "WITH p AS (SELECT year(l_shipdate) AS year, l_suppkey AS bank, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), x AS (SELECT *, CASE WHEN bank % 4 <> 0 THEN q END AS x FROM p)"
_FIG = _BACK + """, f AS (SELECT key, (max(close) FILTER (WHERE r = 1) - max(close) FILTER (WHERE r = least(22, n))) / max(close) FILTER (WHERE r = least(22, n)) AS ret, stddev_samp(change) FILTER (WHERE r <= 22) * sqrt(252) AS vol,
  (max(close) - max(close) FILTER (WHERE r = 1)) / max(close) AS drawdown FROM b WHERE n >= 10 GROUP BY key)"""


def _norms(x: str, a: float, b: float) -> str:
    return f"greatest(0.0, least(1.0, ({x} - {a}) / ({b - a})))"




Q: dict = {
    "latest_report": (lambda t: W.latest(t["orders"], "o_custkey", F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice"), """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""),
    "pareto_cumulative": (lambda t: W.pareto(t.lends, "bank", "amount", "company").select("bank", "company", "amount", F.round("cum_pct", 4).alias("cum_pct")), sql("""
SELECT bank, company, amount, round(100 * sum(amount) OVER (PARTITION BY bank ORDER BY amount DESC, company ROWS UNBOUNDED PRECEDING) / sum(amount) OVER (PARTITION BY bank), 4) AS cum_pct FROM lends""", "lends")),
    "coverage_prefix": (lambda t: W.covering_prefix(t.lends, "bank", "amount", 60.0, "company").select("bank", "company", "amount"), sql("""
, c AS (SELECT *, sum(amount) OVER (PARTITION BY bank ORDER BY amount DESC, company ROWS UNBOUNDED PRECEDING) AS cum, sum(amount) OVER (PARTITION BY bank) AS total FROM lends)
SELECT bank, company, amount FROM c WHERE 100 * cum / total - 100 * amount / total < 60""", "lends")),
    "return_vol_drawdown": (lambda t: W.market_figures(prices(t), "key", "slot", "close").select("key", *[F.round(c, 6).alias(c) for c in ("ret", "vol", "drawdown")]), _FIG + """
SELECT key, round(ret, 6) AS ret, round(vol, 6) AS vol, round(drawdown, 6) AS drawdown FROM f"""),
    "market_stress": (lambda t: W.market_figures(prices(t), "key", "slot", "close").select("key", F.round(S.market_stress(F.col("ret"), F.col("vol"), F.col("drawdown")), 6).alias("stress")), _FIG + f"""
SELECT key, round(({_norms("ret", 0.10, -0.25)} + {_norms("vol", 0.08, 0.45)} + {_norms("drawdown", 0.0, 0.35)}) / 3, 6) AS stress FROM f"""),
    "log_return_vol": (lambda t: W.log_return_volatility(prices(t), "key", "slot", "close").select("key", F.round("vol", 6).alias("vol")), _BACK + """
SELECT key, round(stddev_samp(logr) FILTER (WHERE r <= 63) * sqrt(252), 6) AS vol FROM b GROUP BY key HAVING count(*) >= 65"""),
    "lag_change": (lambda t: prices(t).select("key", "slot", F.round(F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("key").orderBy("slot"))) - 1, 6).alias("change")), f"""
WITH p AS ({_PRICES}) SELECT key, slot, round(close / lag(close) OVER (PARTITION BY key ORDER BY slot) - 1, 6) AS change FROM p"""),
    "mean_last5": (lambda t: W.market_cap(prices(t), t["events"].groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("shares")), "key", "slot", "close").select("key", F.round("close", 6).alias("close5"), F.round("cap", 9).alias("cap")), _BACK + """
SELECT key, round(c, 6) AS close5, round(c * shares / 1e7, 9) AS cap FROM (SELECT key, avg(close) AS c FROM b WHERE r <= 5 GROUP BY key) JOIN (SELECT event_type AS key, count(*) AS shares FROM events GROUP BY 1) USING (key)"""),
    "forward_fill": (lambda t: W.forward_fill(panel(t).select("year", "bank", "x"), "year", "bank", "x").select("year", "bank", "x_filled"), _PANEL + """
SELECT year, bank, last_value(x IGNORE NULLS) OVER (PARTITION BY year ORDER BY bank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x_filled FROM x"""),
    "impute_median": (lambda t: W.impute_median(panel(t), "year", "x").select("year", "bank", "x_imputed"), _PANEL + " SELECT year, bank, coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY year)) AS x_imputed FROM x"),
    "winsorize": (lambda t: W.winsorize(panel(t), "year", "x").select("year", "bank", F.round("x_cut", 4).alias("x_cut")), _PANEL + """
SELECT year, bank, round(CASE WHEN x IS NOT NULL THEN greatest(quantile_cont(x, 0.05) OVER (PARTITION BY year), least(quantile_cont(x, 0.95) OVER (PARTITION BY year), x)) END, 4) AS x_cut FROM x"""),
    "zscore": (lambda t: W.zscore(panel(t), "year", "x").select("year", "bank", F.round("x_z", 6).alias("x_z")), _PANEL + """
SELECT year, bank, round((x - avg(x) OVER (PARTITION BY year)) / nullif(stddev_pop(x) OVER (PARTITION BY year), 0), 6) AS x_z FROM x"""),
    "trend_slope": (lambda t: W.slope(panel(t), "bank", "year", "q").select("bank", F.round("slope", 6).alias("slope")), _PANEL + " SELECT bank, round(coalesce(regr_slope(q, year), 0.0), 6) AS slope FROM p GROUP BY bank"),
    "minmax": (lambda t: W.minmax(t["supplier"].select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("s_acctbal_scaled", 6).alias("scaled")), """
SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS scaled FROM supplier"""),
    "rank_stress": (lambda t: t["customer"].select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("most_stressed"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("least_stressed")), """
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS most_stressed, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS least_stressed FROM customer"""),
    "spearman": (lambda t: W.spearman(panel(t), "year", "n", "q").select("year", "n", F.round("rho", 6).alias("rho"), "signal"), _PANEL + """
, r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY n) + (count(*) OVER (PARTITION BY year, n) - 1) / 2 AS a, rank() OVER (PARTITION BY year ORDER BY q) + (count(*) OVER (PARTITION BY year, q) - 1) / 2 AS b FROM p)
SELECT year, n, CASE WHEN n >= 5 THEN round(rho, 6) END AS rho, CASE WHEN n < 5 THEN 'insufficient data' WHEN abs(rho) >= 0.5 THEN 'STRONG' WHEN abs(rho) >= 0.3 THEN 'MODERATE' ELSE 'WEAK' END AS signal FROM (SELECT year, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY year)"""),
    "describe_quantiles": (lambda t: W.describe(t.lends, "bank", "amount").select("bank", "n", "total", *[F.round(c, 4).alias(c) for c in ("mean", "median", "least", "most", "q95", "q97", "q99", "q999")]), sql("""
SELECT bank, count(amount) AS n, sum(amount) AS total, round(avg(amount), 4) AS mean, round(quantile_cont(amount, 0.5), 4) AS median, min(amount) AS least, max(amount) AS most,
  round(quantile_cont(amount, 0.95), 4) AS q95, round(quantile_cont(amount, 0.97), 4) AS q97, round(quantile_cont(amount, 0.99), 4) AS q99, round(quantile_cont(amount, 0.999), 4) AS q999 FROM lends GROUP BY bank""", "lends")),
    "value_modes": (lambda t: t["part"].groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("n")))).where("r = 1").select("p_brand", "p_size", "n"), """
SELECT p_brand, p_size, n FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS r FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1"""),
    "floor_percentile": (lambda t: W.floor_percentile(t.lends, "bank", "amount", 0.85), sql("""
, r AS (SELECT bank, amount, row_number() OVER (PARTITION BY bank ORDER BY amount) - 1 AS r, count(*) OVER (PARTITION BY bank) AS n FROM lends)
SELECT bank, amount AS value FROM r WHERE r = least(floor(n * 0.85), n - 1)""", "lends")),
    "status_rollup": (lambda t: t["orders"].rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level")), """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""),
    "value_counts": (lambda t: panel(t).groupBy("x").agg(F.count(F.lit(1)).alias("n")), _PANEL + " SELECT x, count(*) AS n FROM x GROUP BY x"),
    "pivot_metric_year": (lambda t: W.long_form(W.pivot_first(t.items.select("bank", F.year("odate").alias("year"), "gross", F.struct("odate", "l_orderkey", "l_linenumber", "gross").alias("seq")), "bank", "year", "gross", "seq"), "bank", "year", "gross"), sql("""
SELECT bank, CAST(year(odate) AS VARCHAR) AS year, arg_min(gross, (odate, l_orderkey, l_linenumber, gross)) AS gross FROM fac GROUP BY ALL""", "fac")),
    "top10_pivot": (lambda t: W.long_form(W.top_groups_pivot(t.items.join(t["part"].select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"), "bank", "p_brand", "amt"), "bank", "brand", "amount"), sql("""
, b AS (SELECT l_suppkey AS bank, p_brand AS brand, floor(l_extendedprice * (1 - l_discount) + 0.5) AS amt FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT brand FROM b GROUP BY brand ORDER BY sum(amt) DESC, brand LIMIT 10)
SELECT bank, brand, sum(amt) AS amount FROM b WHERE brand IN (SELECT brand FROM k) GROUP BY ALL""", "fac")),
    "dedup_first": (lambda t: W.latest(t["events"], "user_id", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id"), """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"""),
    "coverage_filter": (lambda t: panel(t).agg(*[F.round(F.count(c) / F.count(F.lit(1)), 6).alias(c) for c in ("n", "q", "x")]).select(*[(F.col(c) >= 0.6).alias(c) for c in ("n", "q", "x")]), _PANEL + " SELECT count(n) / count(*) >= 0.6 AS n, count(q) / count(*) >= 0.6 AS q, count(x) / count(*) >= 0.6 AS x FROM x"),
    "weighted_mean": (lambda t: t["events"].groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", 2).otherwise(1) * F.col("value")) / F.sum(F.when(F.col("event_type") == "purchase", 2).otherwise(1)), 6).alias("score")), """
SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END * value) / sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END), 6) AS score FROM events GROUP BY user_id"""),
    "panel_stress": (lambda t: panel_stress(panel(t), "bank", "year", {"x": 1, "n": -1, "q": -1}, "x").select("bank", F.round("score", 4).alias("score")), None),
}
