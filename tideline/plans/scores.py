"""Scores over the test tables: companies rated by the priority of their orders, banks by ratios of their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ratings as R
from ..operators import scoring as S
from .views import Tables, sql

AS_OF = "2002-01-01"
_GRADE = "CASE priority WHEN '1-URGENT' THEN 'B-' WHEN '2-HIGH' THEN 'BB' WHEN '3-MEDIUM' THEN 'BBB' WHEN '4-NOT SPECIFIED' THEN 'A' ELSE 'AA' END"
_RATING = f"concat('Crisil ', {_GRADE}, CASE flag WHEN 'R' THEN '/Issuer Not Cooperating' WHEN 'A' THEN '/Stable' ELSE '/Negative' END)"
_PD = "CASE priority WHEN '1-URGENT' THEN 0.12 WHEN '2-HIGH' THEN 0.0286 WHEN '3-MEDIUM' THEN 0.0046 WHEN '4-NOT SPECIFIED' THEN 0.0007 ELSE 0.0005 END"
_DOWN = "CASE g WHEN 'B-' THEN 0.12 WHEN 'BB' THEN 0.0657 WHEN 'BBB' THEN 0.0464 WHEN 'A' THEN 0.0304 ELSE 0.0175 END"
_STRESS = "CASE priority WHEN '1-URGENT' THEN 0.1669 WHEN '2-HIGH' THEN 0.0286 WHEN '3-MEDIUM' THEN 0.0046 WHEN '4-NOT SPECIFIED' THEN 0.0007 ELSE 0.0005 END"


def companies(t: Tables):
    """Company documents: facilities of all their items, and for even ids a long-term rating with outlook."""
    item = F.struct("l_orderkey", "l_linenumber", F.expr(_RATING).alias("rating"), F.col("amt").alias("amount"))
    docs = t.items.groupBy("company").agg(F.array_sort(F.collect_list(item)).alias("facilities"), F.max("odate").cast("date").alias("rating_date"), F.min("priority").alias("best"))
    own = F.array(F.struct(F.regexp_replace(F.expr(_RATING.replace("priority", "best").replace("CASE flag WHEN 'R' THEN '/Issuer Not Cooperating' WHEN 'A' THEN '/Stable' ELSE '/Negative' END", "'/Stable'")), "^$", "").alias("rating"), F.when(F.col("company") % 4 == 0, "Negative").otherwise("Stable").alias("outlook")))
    return docs.withColumn("crisil_ratings", F.when(F.col("company") % 2 == 0, own)).withColumn("instruments", F.lit(None).cast("array<struct<rating:string,issue_size:double>>"))


_ENTITY = f"""
, i AS (SELECT company, amt, odate, priority, least({_PD} * CASE WHEN flag = 'R' THEN 1.5 ELSE 1.0 END, 1.0) AS pd FROM fac),
d AS (SELECT company, min(priority) AS priority, max(CAST(odate AS DATE)) AS rd, count(*) AS n0, sum(amt) AS e, sum(pd * amt) / sum(amt) AS ew0, sum(amt * amt) / (sum(amt) * sum(amt)) AS c8, list(pd) AS pds FROM i GROUP BY company),
l AS (SELECT *, company % 2 = 0 AS rated, {_GRADE} AS g, {_PD} AS lt0, CASE WHEN company % 4 = 0 THEN 1.3 ELSE 1.0 END AS mult FROM d),
p AS (SELECT *, least(ew0 * CASE WHEN rated THEN mult ELSE 1.0 END, 1.0) AS ew, CASE WHEN rated THEN least(lt0 * mult, 1.0) END AS lt, CASE WHEN rated THEN list_append(pds, CAST(lt0 AS DOUBLE)) ELSE pds END AS allp, date_diff('day', rd, DATE '{AS_OF}') AS age FROM l),
c AS (SELECT *, ln(1 + 99 * coalesce(lt, ew)) / ln(100) AS c1, ln(1 + 99 * ew) / ln(100) AS c2, CASE WHEN rated THEN least({_DOWN} / 0.25, 1.0) END AS c3,
  CASE WHEN len(allp) > 1 THEN least(list_stddev_samp(allp) / 0.5, 1.0) END AS c4, least(log10(1 + e) / 4, 1.0) AS c5, 0.0 AS c6,
  CASE WHEN age <= 365 THEN 0.0 ELSE least((age - 365) / 365.0, 1.0) END AS c7, CASE WHEN rated THEN 0.0 END AS c9 FROM p),
s AS (SELECT *, round(100 * (0.25 * c1 + 0.2 * c2 + coalesce(0.15 * c3, 0) + coalesce(0.1 * c4, 0) + 0.1 * c5 + 0.1 * c6 + 0.05 * c7 + 0.03 * c8 + coalesce(0.02 * c9, 0))
  / (0.73 + CASE WHEN c3 IS NULL THEN 0 ELSE 0.15 END + CASE WHEN c4 IS NULL THEN 0 ELSE 0.1 END + CASE WHEN c9 IS NULL THEN 0 ELSE 0.02 END), 2) AS stress FROM c)
"""
_BAND = "CASE WHEN stress < 5 THEN 'Minimal' WHEN stress < 15 THEN 'Low' WHEN stress < 30 THEN 'Moderate' WHEN stress < 50 THEN 'Elevated' WHEN stress < 70 THEN 'High' ELSE 'Severe' END"


def _entity(t: Tables):
    return R.entity_stress(companies(t), F.to_date(F.lit(AS_OF)))


def parts(t: Tables):
    """News, sector and ratings scores per company, some of them missing."""
    c = t["customer"]
    return c.select(
        F.col("c_custkey").alias("company"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 101).cast("double").alias("fundamental"),
        F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 50) / 50.0).alias("news"),
        F.when(F.col("c_custkey") % 5 != 0, (F.col("c_nationkey") + 1) / 26.0).alias("sector"),
    )


_PARTS = """, p AS (SELECT c_custkey AS company, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 101 AS DOUBLE) END AS fundamental,
  CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50) / 50.0 END AS news, CASE WHEN c_custkey % 5 <> 0 THEN (c_nationkey + 1) / 26.0 END AS sector FROM customer)"""


def ratios(t: Tables):
    """Supervisory ratios of each bank, of the sums of its items."""
    g = t["lineitem"].groupBy(F.col("l_suppkey").alias("bank")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_discount") > 0.05).alias("d"), F.count_if(F.col("l_quantity") > 25).alias("q"))
    x = lambda c: F.col(c) / F.col("n")
    return g.select("bank", (20 * x("q")).alias("totalCAR"), (16 * x("o")).alias("tier1CAR"), (25 * x("r")).alias("netNPAToNetAdvances"), (3 * x("d")).alias("returnOnAssets"), (140 * x("q")).alias("creditDepositRatio"), (12 * x("d")).alias("costOfFunds"), (90 * x("o")).alias("wageBillsToTotalExpense"))


RATIOS = ("totalCAR", "tier1CAR", "netNPAToNetAdvances", "returnOnAssets", "creditDepositRatio", "costOfFunds", "wageBillsToTotalExpense")
_RATIOS = """, g AS (SELECT l_suppkey AS bank, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_discount > 0.05) AS d, count(*) FILTER (WHERE l_quantity > 25) AS q FROM lineitem GROUP BY 1),
x AS (SELECT bank, 20 * (q / n) AS car, 16 * (o / n) AS t1, 25 * (r / n) AS npa, 3 * (d / n) AS roa, 140 * (q / n) AS cdr, 12 * (d / n) AS cof, 90 * (o / n) AS wage FROM g),
h AS (SELECT bank, 1 - 1 / (1 + exp((car - 11.5) / 1.125)) AS car, 1 - 1 / (1 + exp((t1 - 9.5) / 1.125)) AS t1,
  CASE WHEN npa <= 0.5 THEN 1.0 WHEN npa <= 6 THEN 1 - 0.3 * (npa - 0.5) / 5.5 WHEN npa <= 9 THEN 0.7 - 0.35 * (npa - 6) / 3 WHEN npa <= 12 THEN 0.35 - 0.25 * (npa - 9) / 3 ELSE greatest(0.0, 0.1 - (npa - 12) * 0.01) END AS npa,
  1 - 1 / (1 + exp(roa / 0.375)) AS roa, exp(-((cdr - 72) * (cdr - 72)) / (2 * 7.5 * 7.5)) AS cdr, 1 / (1 + exp((cof - 7.5) / 0.875)) AS cof, 1 / (1 + exp((wage - 55) / 5.0)) AS wage FROM x)"""


def _camels(t: Tables):
    c = S.camels(ratios(t), {r: r for r in RATIOS})
    return c.select("bank", *[F.round(k, 6).alias(k.lower()) for k in S.CAMELS], F.round("camels", 6).alias("camels"))


_CAMELS = _RATIOS + """, m AS (SELECT bank, 1 - (car + t1) / 2 AS capital, 1 - npa AS assetquality, 1 - wage AS management, 1 - roa AS earnings, 1 - cdr AS liquidity, 1 - cof AS sensitivity FROM h)"""

Q: dict = {
    "entity_stress": (lambda t: _entity(t).select("company", "stress", "label", "tier", *[F.round(k, 6).alias(k) for k in ("c1", "c2", "c4", "c5", "c8")], "active", "skipped"), sql(_ENTITY + f"""
SELECT company, stress, {_BAND} AS label, CASE WHEN NOT rated THEN 'Unrated' WHEN g IN ('AA', 'A', 'BBB') THEN 'Investment Grade' ELSE 'Sub-Investment Grade' END AS tier,
  round(c1, 6) AS c1, round(c2, 6) AS c2, round(c4, 6) AS c4, round(c5, 6) AS c5, round(c8, 6) AS c8,
  'c1,c2' || CASE WHEN rated THEN ',c3' ELSE '' END || CASE WHEN c4 IS NULL THEN '' ELSE ',c4' END || ',c5,c6,c7,c8' || CASE WHEN rated THEN ',c9' ELSE '' END AS active,
  concat_ws(',', CASE WHEN NOT rated THEN 'c3' END, CASE WHEN c4 IS NULL THEN 'c4' END, CASE WHEN NOT rated THEN 'c9' END) AS skipped FROM s""", "fac")),
    "rating_pool": (lambda t: t.items.select("l_orderkey", "l_linenumber", R.resolve(F.expr(_RATING)).alias("r")).select("l_orderkey", "l_linenumber", "r.token", "r.mult"), sql(f"""
SELECT l_orderkey, l_linenumber, {_GRADE} AS token, CAST(CASE WHEN flag = 'R' THEN 1.5 ELSE 1.0 END AS DOUBLE) AS mult FROM fac""".replace("'/Negative'", "''"), "fac")),
    "cdr_weighted_median": (lambda t: companies(t).select("company", R.weighted_median(F.col("facilities")).alias("m")).select("company", "m.score", "m.basis", "m.scored", "m.skipped", "m.total", "m.dominant"), sql(f"""
, i AS (SELECT company, amt, {_RATING.replace("concat(", "concat(")} AS rating, least({_STRESS} * CASE WHEN flag = 'R' THEN 3.0 ELSE 1.0 END, 1.0) AS s,
  sum(amt) OVER (PARTITION BY company) AS total, sum(amt) OVER (PARTITION BY company ORDER BY amt DESC, l_orderkey, l_linenumber, {_RATING} ROWS UNBOUNDED PRECEDING) AS cum FROM fac)
SELECT company, round(CAST(arg_min(s, cum) FILTER (WHERE cum / total >= 0.5) AS DOUBLE), 6) AS score, 'weighted_median' AS basis, CAST(count(*) AS INTEGER) AS scored, CAST(0 AS INTEGER) AS skipped, round(any_value(total), 4) AS total,
  arg_min(rating, cum) FILTER (WHERE cum / total >= 0.5) AS dominant FROM i GROUP BY company""", "fac")),
    "company_blend": (lambda t: parts(t).select("company", F.round(S.company_blend(F.col("fundamental"), F.col("news"), F.col("sector")), 6).alias("stress")), sql(_PARTS + """
SELECT company, round(CASE WHEN news IS NOT NULL AND sector IS NOT NULL THEN 0.7 * fundamental / 100 + 0.2 * news + 0.1 * sector WHEN news IS NOT NULL THEN 0.8 * fundamental / 100 + 0.2 * news
  WHEN sector IS NOT NULL THEN 0.8 * fundamental / 100 + 0.2 * sector ELSE fundamental / 100 END, 6) AS stress FROM p""", ).replace(", p AS", "WITH p AS", 1)),
    "bank_blend": (lambda t: parts(t).select("company", F.round(S.bank_blend(F.col("fundamental") / 100, F.col("sector"), F.col("news"), F.col("news"), F.col("sector")), 6).alias("stress")), sql(_PARTS + """
SELECT company, round(coalesce(0.23 * fundamental / 100 + 0.23 * sector + 0.54 * news, 0.73 * sector + 0.27 * news, sector), 6) AS stress FROM p""").replace(", p AS", "WITH p AS", 1)),
    "sector_blend_tier": (lambda t: parts(t).withColumn("s", S.sector_blend(F.col("news"), F.col("sector"))).select("company", F.col("s").alias("score"), S.risk_tier(F.col("s")).alias("tier")), sql(_PARTS + """
, b AS (SELECT company, round(coalesce((news + sector) / 2, news), 4) AS s FROM p)
SELECT company, s AS score, CASE WHEN s IS NULL THEN NULL WHEN s < 0.2 THEN 'Minimal' WHEN s < 0.4 THEN 'Low' WHEN s < 0.55 THEN 'Moderate' WHEN s < 0.7 THEN 'Elevated' WHEN s < 0.85 THEN 'High' ELSE 'Severe' END AS tier FROM b""").replace(", p AS", "WITH p AS", 1)),
    "health_transforms": (lambda t: ratios(t).select("bank", *[F.round(S.health(r, F.col(r)), 6).alias(r.lower()) for r in RATIOS]), sql(_RATIOS + """
SELECT bank, round(car, 6) AS totalcar, round(t1, 6) AS tier1car, round(npa, 6) AS netnpatonetadvances, round(roa, 6) AS returnonassets, round(cdr, 6) AS creditdepositratio, round(cof, 6) AS costoffunds, round(wage, 6) AS wagebillstototalexpense FROM h""").replace(", g AS", "WITH g AS", 1)),
    "camels": (_camels, sql(_CAMELS + """
SELECT bank, round(capital, 6) AS capital, round(assetquality, 6) AS assetquality, round(management, 6) AS management, round(earnings, 6) AS earnings, round(liquidity, 6) AS liquidity, round(sensitivity, 6) AS sensitivity,
  round(0.25 * capital + 0.3 * assetquality + 0.1 * management + 0.2 * earnings + 0.1 * liquidity + 0.05 * sensitivity, 6) AS camels FROM m""").replace(", g AS", "WITH g AS", 1)),
    "rkmss_blend": (lambda t: S.camels(ratios(t), {r: r for r in RATIOS}).select("bank", F.round(S.final_blend(F.col("Capital"), F.col("Earnings"), F.col("camels")), 6).alias("score")), sql(_CAMELS + """
SELECT bank, round(greatest(0, least(1, 0.4 * capital + 0.35 * earnings + 0.25 * (0.25 * capital + 0.3 * assetquality + 0.1 * management + 0.2 * earnings + 0.1 * liquidity + 0.05 * sensitivity))), 6) AS score FROM m""").replace(", g AS", "WITH g AS", 1)),
    "danger_vector": (lambda t: ratios(t).agg(F.lit(11.5).alias("totalcar"), F.round(F.max(1 - S.health("returnOnAssets", F.col("returnOnAssets"))), 6).alias("earnings"), F.round(F.max(1 - S.health("costOfFunds", F.col("costOfFunds"))), 6).alias("funds")), sql(_RATIOS + """
SELECT CAST(11.5 AS DOUBLE) AS totalcar, round(max(1 - roa), 6) AS earnings, round(max(1 - cof), 6) AS funds FROM h""").replace(", g AS", "WITH g AS", 1)),
    "debt_proxy": (lambda t: t["supplier"].select(F.col("s_suppkey").alias("bank"), F.round(S.debt_proxy(F.when(F.col("s_acctbal") > 3000, F.col("s_acctbal")), F.col("s_acctbal") * 0.5, F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 2), F.abs("s_acctbal")), 4).alias("debt")), """
SELECT s_suppkey AS bank, round(coalesce(CASE WHEN s_acctbal > 3000 THEN s_acctbal END + 0.5 * (s_acctbal * 0.5), 0.9 * CASE WHEN s_acctbal > 0 THEN s_acctbal * 2 END, 10 * abs(s_acctbal)), 4) AS debt FROM supplier"""),
    "hhi": (lambda t: S.herfindahl(t.lends, "bank", "amount").select("bank", F.round("hhi", 6).alias("hhi")), sql("SELECT bank, round(sum(amount * amount) / (sum(amount) * sum(amount)), 6) AS hhi FROM lends GROUP BY bank", "lends")),
    "key_drivers": (lambda t: t["events"].groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("less"), F.col("event_id").alias("id")))).alias("e")).select("user_id", F.array_join(F.transform(F.when(F.size(F.filter("e", lambda x: -x["less"] > 50)) > 0, F.slice(F.filter("e", lambda x: -x["less"] > 50), 1, 3)).otherwise(F.slice("e", 1, 1)), lambda x: x["id"].cast("string")), ",").alias("drivers")), """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS drivers FROM r WHERE (value > 50 AND r <= 3) OR r = 1 GROUP BY user_id"""),
}
