"""Graph queries and edge builders over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import graph_queries as G
from .views import Tables, sql

SUBSIDIARY = "n >= 2"  # related parties with several transactions stand for subsidiaries

Q: dict = {
    "q1_common_owners": (lambda t: G.common_owners(t.holds), sql("""
SELECT owner, count(DISTINCT bank) AS bank_count, string_agg(DISTINCT CAST(bank AS VARCHAR), ',' ORDER BY CAST(bank AS VARCHAR)) AS banks
FROM holds GROUP BY owner HAVING count(DISTINCT bank) >= 2""", "holds")),
    "q2_bank_bank_ownership": (lambda t: G.bank_ownership(t.bank_holds), sql("SELECT owner AS owner_bank, bank AS target_bank, pct AS stake_pct FROM bank_holds", "bank_holds")),
    "q3_dual_borrowers": (lambda t: G.dual_borrowers(t.lends, t.industry), sql("""
, m AS (SELECT company, round(sum(amount), 2) AS total_exposure FROM lends GROUP BY company HAVING count(DISTINCT bank) >= 2)
SELECT bank, company, industry, total_exposure FROM lends JOIN m USING (company) JOIN industry USING (company) ORDER BY total_exposure DESC, company, bank LIMIT 100""", "lends", "industry")),
    "q4_triple_borrowers": (lambda t: G.shared_borrowers(t.lends, 3), sql("""
SELECT company, count(DISTINCT bank) AS lender_count, string_agg(DISTINCT CAST(bank AS VARCHAR), ',' ORDER BY CAST(bank AS VARCHAR)) AS lenders, round(sum(amount), 2) AS total_exposure
FROM lends GROUP BY company HAVING count(DISTINCT bank) >= 3""", "lends")),
    "q5_loans_to_rpt_of_other": (lambda t: G.loans_to_related_of_other(t.lends, t.rpt), sql("""
SELECT l.bank AS lending_bank, r.bank AS rpt_bank, l.company, l.amount AS loan_amount, r.up AS rpt_exposure FROM lends l JOIN rpt r ON l.company = r.company WHERE l.bank <> r.bank""", "lends", "rpt")),
    "q6_own_subsidiary_loans": (lambda t: G.own_subsidiary_loans(t.lends, t.rpt.where(SUBSIDIARY)), sql(f"""
SELECT l.bank, l.company, l.amount AS loan_amount FROM lends l JOIN rpt r ON l.company = r.company AND l.bank = r.bank WHERE r.{SUBSIDIARY}""", "lends", "rpt")),
    "q7_subsidiary_two_hop": (lambda t: G.subsidiary_two_hop(t.lends, t.rpt.where(SUBSIDIARY)), sql(f"""
SELECT r.bank AS parent_bank, l.bank AS lending_bank, l.company, l.amount AS exposure FROM lends l JOIN rpt r ON l.company = r.company WHERE l.bank <> r.bank AND r.{SUBSIDIARY}""", "lends", "rpt")),
    "q8_borrower_holds_other": (lambda t: G.borrower_holds_other(t.lends, t.holds), sql("""
SELECT l.bank AS lending_bank, h.bank AS bank_with_stake, l.company, l.amount AS credit_exposure, h.pct AS stake_pct FROM lends l JOIN holds h ON l.company = h.owner WHERE l.bank <> h.bank""", "lends", "holds")),
    "q9_rpt_bridge": (lambda t: G.related_bridge(t.lends, t.rpt), sql("""
SELECT l.bank AS lending_bank, r.bank AS rpt_bank, l.company, CAST(sum(r.n) AS BIGINT) AS rpt_count FROM lends l JOIN rpt r ON l.company = r.company WHERE l.bank <> r.bank
GROUP BY ALL ORDER BY rpt_count DESC, lending_bank, rpt_bank, l.company LIMIT 50""", "lends", "rpt")),
    "q10_conflict_triangle": (lambda t: G.conflict_triangle(t.holds, t.lends, t.co_lends), sql("""
SELECT h.owner, h.bank, c.company FROM holds h JOIN co_lends c ON c.lender = h.owner JOIN lends l ON l.bank = h.bank AND l.company = c.company""", "holds", "lends", "co_lends")),
    "q11_top_industry": (lambda t: G.top_industry(t.lends, t.industry), sql("""
SELECT bank, industry, round(sum(amount), 2) AS exposure, count(DISTINCT company) AS num_companies FROM lends JOIN industry USING (company)
GROUP BY ALL ORDER BY bank, exposure DESC, industry LIMIT 60""", "lends", "industry")),
    "q11b_top5_rollup": (lambda t: G.top_industries_per_bank(t.lends, t.industry), sql("""
, s AS (SELECT bank, industry, round(sum(amount), 2) AS exposure FROM lends JOIN industry USING (company) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY exposure DESC, industry) AS r FROM s)
SELECT bank, max(industry) FILTER (WHERE r = 1) AS top_industry, string_agg(industry, ',' ORDER BY r) AS top_list, round(sum(exposure), 2) AS top_exposure FROM r WHERE r <= 5 GROUP BY bank""", "lends", "industry")),
    "q12_industry_breakdown": (lambda t: G.industry_exposure(t.lends, t.industry), sql("""
SELECT bank, industry, round(sum(amount), 2) AS exposure, count(DISTINCT company) AS num_companies FROM lends JOIN industry USING (company) GROUP BY ALL""", "lends", "industry")),
    "q13_priority_exposure": (lambda t: E.priority_exposure(t.fac).select("sector", "bank", "outstanding"), sql("""
SELECT facility AS sector, bank, round(sum(amt), 2) AS outstanding FROM fac GROUP BY ALL""", "fac")),
    "q14_bank_bank_rpt": (lambda t: G.bank_bank_related(t.bank_rpt), sql("SELECT a AS from_bank, b AS to_bank, parts AS txn_count FROM bank_rpt", "bank_rpt")),
    "q15_rpt_and_borrower": (lambda t: G.related_and_borrower(t.lends, t.rpt), sql("""
SELECT l.company, r.bank AS rpt_with_bank, l.bank AS borrows_from_bank, l.amount AS loan_amount, r.up AS rpt_exposure, l.bank = r.bank AS same_bank FROM lends l JOIN rpt r ON l.company = r.company""", "lends", "rpt")),
    "q16_category_stakes": (lambda t: G.category_stakes(t.holds), sql("""
SELECT bank, category, round(sum(pct), 4) AS category_pct, count(DISTINCT owner) AS num_holders FROM holds GROUP BY ALL""", "holds")),
    "q17_reach": (lambda t: G.reach(t.holds), sql("""
SELECT owner, count(DISTINCT bank) AS total_holdings, round(sum(pct), 4) AS total_stake_pct FROM holds GROUP BY owner ORDER BY total_holdings DESC, total_stake_pct DESC, owner LIMIT 30""", "holds")),
    "q18_shared_subgraph": (lambda t: G.shared_subgraph(t.lends), sql("""
SELECT bank, company, amount FROM lends WHERE company IN (SELECT company FROM lends GROUP BY company HAVING count(DISTINCT bank) > 1)""", "lends")),
    "q19_company_ego": (lambda t: G.company_ego(1, t.lends, t.rpt, t.holds), sql("""
SELECT 'LENDS_TO' AS type, bank AS src, company AS dst FROM lends WHERE company = 1
UNION ALL SELECT 'RELATED_PARTY', company, bank FROM rpt WHERE company = 1 UNION ALL SELECT 'SHAREHOLDER_OF', owner, bank FROM holds WHERE owner = 1""", "lends", "rpt", "holds")),
    "q20_degree_proxy": (lambda t: G.degree_proxy(t.lends, t.rpt, t.holds), sql("""
, e AS (SELECT company, bank, 'LENDS_TO' AS type FROM lends UNION ALL SELECT company, bank, 'RELATED_PARTY' FROM rpt UNION ALL SELECT owner, bank, 'SHAREHOLDER_OF' FROM holds)
SELECT company, count(DISTINCT bank) AS bank_count, count(DISTINCT type) AS type_count, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM e GROUP BY company
ORDER BY bank_count DESC, type_count DESC, company LIMIT 50""", "lends", "rpt", "holds")),
    "q21_chain2": (lambda t: G.chain2(t.lends, t.co_lends), sql("""
SELECT l.bank, l.company AS company1, c.company AS company2 FROM lends l JOIN co_lends c ON c.lender = l.company""", "lends", "co_lends")),
    "q22_chain3": (lambda t: G.chain3(t.lends, t.co_lends), sql("""
SELECT l.bank, l.company AS company1, c.company AS company2, d.company AS company3 FROM lends l JOIN co_lends c ON c.lender = l.company JOIN co_lends d ON d.lender = c.company""", "lends", "co_lends")),
    "q23_bipartite_top": (lambda t: G.bipartite_top(t.lends), sql("SELECT bank, company, amount FROM lends ORDER BY amount DESC, bank, company LIMIT 200", "lends")),
    "q24_bank_ego2": (lambda t: G.bank_ego(1, t.lends), sql("""
SELECT 'company' AS kind, company AS id, 1 AS hops FROM lends WHERE bank = 1
UNION ALL SELECT DISTINCT 'bank', bank, 2 FROM lends WHERE bank <> 1 AND company IN (SELECT company FROM lends WHERE bank = 1)""", "lends")),
    "q25_cluster2": (lambda t: G.bank_cluster(t.lends), sql("""
SELECT x.bank AS a, y.bank AS b, count(DISTINCT x.company) AS shared FROM lends x JOIN lends y ON x.company = y.company AND x.bank < y.bank GROUP BY ALL""", "lends")),
    "q26_bank_company_industry": (lambda t: G.bank_company_industry(t.lends, t.industry), sql("SELECT bank, company, industry, amount FROM lends JOIN industry USING (company)", "lends", "industry")),
    "q27_owner_bank_borrower": (lambda t: G.owner_bank_borrower(t.holds, t.lends), sql("""
SELECT h.owner, h.bank, l.company, h.pct FROM holds h JOIN lends l ON h.bank = l.bank WHERE h.pct IS NOT NULL""", "holds", "lends")),
    "q28_circular": (lambda t: G.circular(t.lends, t.holds), sql("""
SELECT l.company, l.bank, l.amount, h.pct FROM lends l JOIN holds h ON h.owner = l.company AND h.bank = l.bank""", "lends", "holds")),
    "q29_rpt_lending_overlap": (lambda t: G.related_lending_overlap(t.lends, t.rpt), sql("""
SELECT l.bank, l.company, l.amount AS loan_amount, r.up AS rpt_exposure FROM lends l JOIN rpt r ON r.bank = l.bank AND r.company = l.company""", "lends", "rpt")),
    "q30_overview": (lambda t: G.overview(t["supplier"], t.lends, t.rpt, t.holds), sql("""
, b AS (SELECT s_suppkey AS bank FROM supplier)
SELECT bank, coalesce(any_value(x.n), 0) AS borrowers, coalesce(any_value(y.n), 0) AS related, coalesce(any_value(z.n), 0) AS holders
FROM b LEFT JOIN (SELECT bank, count(*) AS n FROM lends GROUP BY bank) x USING (bank) LEFT JOIN (SELECT bank, count(*) AS n FROM rpt GROUP BY bank) y USING (bank)
LEFT JOIN (SELECT bank, count(*) AS n FROM holds GROUP BY bank) z USING (bank) GROUP BY bank""", "lends", "rpt", "holds")),
}

# Facilities of the test tables stand for three buckets and names with words in them.
_KIND = "CASE WHEN flag = 'R' THEN 'unsecured overdraft' WHEN flag = 'A' THEN 'term loan' ELSE 'letter of credit' END"
_BUCKET = "CASE WHEN status = 'O' THEN 'Term Loans' ELSE 'Bills Purchased & Discounted' END"
_RISKY = "SELECT bank, company, amt, " + _KIND + " AS facility, " + _BUCKET + """ AS bucket,
  CASE WHEN flag = 'R' THEN 'Unsecured' WHEN status = 'O' THEN 'Secured' ELSE 'Senior' END AS lgd_category,
  CASE WHEN flag = 'R' THEN 0.6 WHEN status = 'O' THEN 0.4 ELSE 0.3 END AS lgd,
  CASE WHEN flag = 'R' THEN 'WC' WHEN flag = 'A' THEN 'TermLoan' ELSE 'Guarantee' END AS t_category,
  CASE WHEN flag = 'R' THEN 0.7 WHEN flag = 'A' THEN 0.9 ELSE 0.3 END AS t FROM fac"""
_DIRECTION = "CASE WHEN status = 'F' AND flag = 'N' THEN 'contingent' WHEN flag = 'R' THEN 'cash_in' WHEN flag = 'A' THEN 'cash_out' WHEN status = 'O' THEN 'cash_in' ELSE 'unknown' END"
_TXN = f"SELECT company, bank, priority AS relation, CAST(year(odate) AS VARCHAR) AS period, gross AS approved, amt AS outstanding, {_DIRECTION} AS direction FROM fac"


def _facilities(t: Tables):
    return t.items.select("bank", "company", "amt", F.expr(_KIND).alias("facility"), F.expr(_BUCKET).alias("bucket"))


def _transactions(t: Tables):
    kind = F.expr("CASE flag WHEN 'R' THEN 'Loan' WHEN 'A' THEN 'Borrowing' ELSE 'Any other transaction' END")
    details = F.expr("CASE WHEN status = 'F' AND flag = 'N' THEN 'Guarantees given' WHEN status = 'O' THEN 'Interest received' ELSE 'Other' END")
    return t.items.select("company", "bank", F.col("priority").alias("relation"), F.year("odate").cast("string").alias("period"), F.col("gross").alias("approved"), F.col("amt").alias("outstanding"), E.direction(kind, details).alias("direction"))


def _tier1(t: Tables):
    return t.items.groupBy("bank").agg((F.sum("amt") * 0.1).alias("tier1"))


Q |= {
    "facility_risk": (lambda t: t.items.select("l_orderkey", "l_linenumber", E.facility_risk(F.expr(_KIND), F.expr(_BUCKET)).alias("r")).select("l_orderkey", "l_linenumber", "r.*"), sql(
        "SELECT l_orderkey, l_linenumber, lgd_category, CAST(lgd AS DOUBLE) AS lgd, t_category, CAST(t AS DOUBLE) AS t FROM (" + _RISKY.replace("SELECT bank", "SELECT l_orderkey, l_linenumber, bank") + ")", "fac")),
    "edge_lends_bank_side": (lambda t: E.lends_bank_side(_facilities(t)), sql(f"""
, r AS ({_RISKY}), l AS (SELECT bank, company, arg_max(lgd_category, (amt, lgd_category)) AS lgd_category FROM (SELECT bank, company, lgd_category, sum(amt) AS amt FROM r GROUP BY ALL) GROUP BY ALL),
k AS (SELECT bank, company, arg_max(t_category, (amt, t_category)) AS t_category FROM (SELECT bank, company, t_category, sum(amt) AS amt FROM r GROUP BY ALL) GROUP BY ALL)
SELECT bank, company, round(sum(amt), 2) AS total_amount, count(*) AS facility_count, string_agg(DISTINCT facility, ',' ORDER BY facility) AS facility_types,
  round(sum(amt * lgd) / sum(amt), 6) AS lgd_multiplier, round(sum(amt * t) / sum(amt), 6) AS t_multiplier, any_value(l.lgd_category) AS lgd_category, any_value(k.t_category) AS t_category
FROM r JOIN l USING (bank, company) JOIN k USING (bank, company) GROUP BY bank, company""", "fac")),
    "edge_lends_company_side": (lambda t: E.lends_company_side(t.items, _tier1(t)), sql("""
, p AS (SELECT bank, company, sum(amt) AS amount FROM fac GROUP BY ALL), k AS (SELECT bank, sum(amt) * 0.1 AS tier1 FROM fac GROUP BY bank)
SELECT bank, company, round(amount, 2) AS amount, round(amount / sum(amount) OVER (PARTITION BY company), 6) AS transmittance, round(least(amount / tier1, 1.0), 6) AS absorption FROM p JOIN k USING (bank)""", "fac")),
    "edge_lends_merged": (lambda t: E.lends_merged(_facilities(t)), sql(f"""
, r AS ({_RISKY})
SELECT bank, company, round(sum(amt), 2) AS total_amount, CASE WHEN count(DISTINCT nullif(lgd_category, 'Unknown')) > 1 THEN 'Mixed' ELSE coalesce(max(nullif(lgd_category, 'Unknown')), 'Unknown') END AS lgd_category,
  CASE WHEN count(DISTINCT nullif(t_category, 'Unknown')) > 1 THEN 'Mixed' ELSE coalesce(max(nullif(t_category, 'Unknown')), 'Unknown') END AS t_category FROM r GROUP BY ALL""", "fac")),
    "edge_related_party": (lambda t: E.related_party(_transactions(t)), sql(f"""
, t AS ({_TXN}), m AS (SELECT company, bank, arg_min(relation, (-k, relation)) AS primary_relation FROM (SELECT company, bank, relation, count(*) AS k FROM t GROUP BY ALL) GROUP BY ALL)
SELECT company, bank, count(*) AS txn_count, round(coalesce(sum(outstanding) FILTER (WHERE direction = 'cash_in'), 0.0), 2) AS cash_in, round(coalesce(sum(outstanding) FILTER (WHERE direction = 'cash_out'), 0.0), 2) AS cash_out,
  round(coalesce(sum(outstanding) FILTER (WHERE direction = 'contingent'), 0.0), 2) AS contingent, round(sum(approved), 2) AS approved, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations,
  any_value(primary_relation) AS primary_relation, string_agg(DISTINCT period, ',' ORDER BY period) AS periods FROM t JOIN m USING (company, bank) GROUP BY company, bank""", "fac")),
    "edge_priority_exposure": (lambda t: E.priority_exposure(t.fac), sql("""
, s AS (SELECT bank, facility AS sector, sum(amt) AS o FROM fac GROUP BY ALL)
SELECT bank, sector, round(o, 2) AS outstanding, round(o / sum(o) OVER (PARTITION BY bank), 6) AS share FROM s""", "fac")),
    "edge_shareholder": (lambda t: t.holds, sql("SELECT owner, bank, category, pct FROM holds", "holds")),
    "summary_rpt": (lambda t: E.related_summary(_transactions(t)), sql(f"""
, t AS ({_TXN})
SELECT bank, direction, count(*) AS txn_count, count(DISTINCT company) AS parties, round(sum(outstanding), 2) AS outstanding, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM t GROUP BY ALL""", "fac")),
    "graph_counts": (lambda t: t.lends.select(F.lit("LENDS_TO").alias("type")).unionByName(t.rpt.select(F.lit("RELATED_PARTY").alias("type"))).unionByName(t.holds.select(F.lit("SHAREHOLDER_OF").alias("type"))).groupBy("type").agg(F.count(F.lit(1)).alias("edges")), sql("""
SELECT type, count(*) AS edges FROM (SELECT 'LENDS_TO' AS type FROM lends UNION ALL SELECT 'RELATED_PARTY' FROM rpt UNION ALL SELECT 'SHAREHOLDER_OF' FROM holds) GROUP BY type""", "lends", "rpt", "holds")),
    "facility_by_industry": (lambda t: t.items.join(t.industry, "company").groupBy("bank", F.coalesce("industry", F.lit("Unknown")).alias("industry")).agg(F.round(F.sum("amt"), 2).alias("advances"), F.count_distinct("company").alias("companies")), sql("""
SELECT bank, coalesce(industry, 'Unknown') AS industry, round(sum(amt), 2) AS advances, count(DISTINCT company) AS companies FROM fac JOIN industry USING (company) GROUP BY ALL""", "fac", "industry")),
}
