"""Nodes, stand-ins, predicates and sector reports over the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import predicates as B
from ..functions.taxonomy import SECTORS
from ..functions.taxonomy import taxonomy as sector_taxonomy
from ..operators import companies as C
from ..operators import matching as M
from ..operators import nodes as N
from ..operators import sectors as S
from ..operators.shared import shared_path
from ..sources import files
from .views import Tables, sql

# Holders of the test tables: banks, companies, and names that nothing is known of, by the owner's key.
_RAW = "CASE owner % 3 WHEN 0 THEN s_name WHEN 1 THEN c_name ELSE concat('Holder ', CAST(owner AS {string})) END"


def holdings(t: Tables):
    """Holdings in banks and, for the other half, in companies: (raw, category, dst_kind, dst, pct, shares, seq)."""
    bank, company = t["supplier"].select("s_suppkey", "s_name"), t["customer"].select("c_custkey", "c_name")
    rows = t.holds.join(bank, F.col("bank") == F.col("s_suppkey")).join(company, F.col("owner") == F.col("c_custkey"))
    even = F.col("owner") % 2 == 0
    return rows.select(
        F.expr(_RAW.format(string="STRING")).alias("raw"), "category", F.when(even, "Bank").otherwise("Company").alias("dst_kind"),
        F.when(even, F.concat(F.lit("b"), ((F.col("bank") + F.col("owner")) % 10 + 1).cast("string"))).otherwise(F.concat(F.lit("c"), F.col("bank").cast("string"))).alias("dst"), "pct", (F.col("owner") * 10).alias("shares"), F.struct("owner", "bank").alias("seq"),
    )


def resolved(t: Tables):
    """Names of banks and companies."""
    banks = t["supplier"].select(F.col("s_name").alias("raw"), F.lit("Bank").alias("kind"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("entity"))
    return banks.unionByName(t["customer"].select(F.col("c_name").alias("raw"), F.lit("Company").alias("kind"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity")))


_HOLD = f""", h AS (SELECT {_RAW.format(string="VARCHAR")} AS raw, category, CASE WHEN owner % 2 = 0 THEN 'Bank' ELSE 'Company' END AS dst_kind,
  CASE WHEN owner % 2 = 0 THEN 'b' || ((bank + owner) % 10 + 1) ELSE 'c' || bank END AS dst, pct, owner * 10 AS shares, owner, bank FROM holds JOIN supplier ON s_suppkey = bank JOIN customer ON c_custkey = owner),
k AS (SELECT s_name AS raw, 'Bank' AS kind, 'b' || s_suppkey AS entity FROM supplier UNION ALL SELECT c_name, 'Company', 'c' || c_custkey FROM customer)"""


def loans(t: Tables):
    """Loans of companies from banks by name, from lenders that nothing is known of, and from none."""
    lender = F.expr("CASE WHEN bank % 4 = 0 THEN concat(' Old Lender & Co. ', CAST(bank AS STRING), ' ') WHEN bank % 7 = 1 THEN 'N/A' WHEN bank % 7 = 2 THEN ' Nil ' ELSE s_name END")
    return t.lends.join(t["supplier"].select(F.col("s_suppkey").alias("bank"), "s_name"), "bank").select(F.col("company").alias("borrower"), lender.alias("lender"), "amount")


_LOANS = """, b AS (SELECT company AS borrower, CASE WHEN bank % 4 = 0 THEN 'Old Lender & Co. ' || bank WHEN bank % 7 IN (1, 2) THEN NULL ELSE s_name END AS raw, 'b' || bank AS own, bank % 4 = 0 AS old, 'LSTUB_old_lender_co_' || bank AS stub, amount
  FROM lends JOIN supplier ON s_suppkey = bank)"""
_TAX = "SELECT DISTINCT p_type || ' ' || p_brand AS industry, split_part(p_type, ' ', 1) AS macro FROM part"


def taxonomy(t: Tables):
    return t["part"].select(F.concat_ws(" ", "p_type", "p_brand").alias("industry"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("macro")).distinct()


def sector_scores(t: Tables):
    """A score for macro sectors but the first by name of the types."""
    macro = taxonomy(t).select("macro").distinct()
    return macro.select("macro", S.dry_score(F.col("macro")).alias("score")).where("score > 0.2")


_DRY = "round(0.1 + 0.8 * CAST(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296, 4)"
_SCORES = f", x AS ({_TAX}), m AS (SELECT macro, {_DRY.format('macro')} AS score FROM (SELECT DISTINCT macro FROM x)), s AS (SELECT * FROM m WHERE score > 0.2)"
_WITH = lambda body: "WITH " + body.lstrip(", ")


def _replies(t: Tables):
    k = F.col("c_custkey")
    score = F.concat(F.lit('{"stress_score": '), (k % 30 / 20).cast("string"), F.lit(', "reasoning": "r'), k.cast("string"), F.lit('"}'))
    reply = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), score, F.lit("\n```"))).when(k % 4 == 1, score).when(k % 4 == 2, F.lit('{"reasoning": "none"}')).otherwise("no JSON here")
    return t["customer"].select("c_custkey", S.score_reply(reply).alias("r")).select("c_custkey", "r.*")


def _bank_docs(t: Tables):
    """Two documents of two banks in three, in order of their balance; one in ten without a name."""
    k = F.col("s_suppkey")
    one = t["supplier"].where(k % 3 != 0).select(F.concat(F.lit("B"), k.cast("string")).alias("symbol"), F.when(k % 10 != 0, F.col("s_name")).alias("name"), F.when(k % 4 != 0, k * 100).alias("shares"), (k * 2).alias("holders"), F.round(F.col("s_acctbal") / 10000, 4).alias("stress"), F.lit(1).alias("seq"))
    return one.unionByName(one.withColumn("seq", F.lit(2)).withColumn("shares", F.col("shares") + 1).withColumn("name", F.upper("name")))


def _company_docs(t: Tables):
    k = F.col("o_custkey")
    return t["orders"].select(F.concat(F.lit("C"), k.cast("string")).alias("cin"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("sector"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderkey").alias("seq"))


# A mapping in the form of a file: names in several categories belong to the first.
_MAPPING = '{"Term Loans": ["1-URGENT", "2-HIGH"], "Working Capital": ["2-HIGH", "3-MEDIUM"]}'


def _facilities(t: Tables):
    at = shared_path(t.spark, "mapping")
    t.spark.createDataFrame([(_MAPPING,)], "value string").coalesce(1).write.text(at)
    return S.categorize(t.items.select("bank", F.col("priority").alias("facility"), F.col("amt").alias("amount")), files.read_mapping(t.spark, at))


_INDUSTRIES = ", ".join("('" + x.replace("'", "''") + "', '" + macro.replace("'", "''") + f"', {i})" for i, (x, macro) in enumerate((x, macro) for macro, names in SECTORS.items() for x in names))


def _by_sector(t: Tables):
    """Parts as companies of all industries of the taxonomy, and some of none, counted by macro sector."""
    names = F.array(*[F.lit(x) for xs in SECTORS.values() for x in xs])
    rows = t["part"].select(F.get(names, (F.col("p_partkey") % 160).cast("int")).alias("industry"))
    return rows.join(sector_taxonomy(t.spark), "industry", "left").groupBy(F.coalesce("macro", F.lit("Unclassified")).alias("macro")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("industry").alias("industries"))


# Order priorities of the test tables stand for categories of lending.
_SECTOR_OF = {"1-URGENT": "agriculture", "2-HIGH": "msme", "3-MEDIUM": "housing", "4-NOT SPECIFIED": "weakerSections"}


def _sector(priority: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _SECTOR_OF.items() for x in pair])[priority]


def _targets(t: Tables):
    """Banks with a balance, and all companies, as nodes that can be held."""
    return t["supplier"].where("s_acctbal > 0").select(F.lit("Bank").alias("kind"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("node")).unionByName(t["customer"].select(F.lit("Company").alias("kind"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")))


def _owned(t: Tables):
    """Transactions of banks with their subsidiaries; a transaction's relation is that of its order."""
    direction = F.when(F.col("flag") == "R", "cash_out").when(F.col("flag") == "A", "cash_in").when(F.col("status") == "F", "contingent").otherwise("unknown")
    rows = t.items.where(B.is_subsidiary(F.concat("priority", F.when(F.col("company") % 5 == 0, " Subsidiary").otherwise(" other"))))
    return rows.select("company", "bank", direction.alias("direction"), F.col("priority").alias("relation"), F.col("gross").alias("approved"), F.col("amt").alias("outstanding"), F.col("l_orderkey").alias("seq"))


def _consolidated(t: Tables):
    """Companies by code, a bridge for most of them, a registry of their nations, and holdings by symbol."""
    c = t["customer"]
    companies = c.select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("code"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("S"), F.col("c_custkey").cast("string"))).otherwise("").alias("symbol"))
    bridge = c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("cin"))
    registry = c.where("c_custkey % 7 <> 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("cin"), F.col("c_mktsegment").alias("status"))
    holdings = t["orders"].select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("symbol"), F.col("o_orderkey").alias("filing"))
    return C.consolidate(companies, bridge, registry, holdings)


Q: dict = {
    "companies_consolidated": (_consolidated, """
SELECT ' c' || c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN 'S' || c_custkey ELSE '' END AS symbol, CASE WHEN c_custkey % 5 <> 0 THEN 'U' || c_custkey END AS cin,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_mktsegment END AS status, CASE WHEN c_custkey % 3 = 0 THEN filing END AS filing
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS filing FROM orders GROUP BY 1) ON o_custkey = c_custkey"""),
    "banks_in_both": (lambda t: C.in_all("bank", t["lineitem"].where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("bank")), t["supplier"].where("s_acctbal > 0").select(F.col("s_suppkey").alias("bank"))), "SELECT s_suppkey AS bank FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')"),
    "stress_counters": (lambda t: C.counters(t["customer"], "c_mktsegment", "c_acctbal", F.col("c_acctbal") < 0).select("whole", "c_mktsegment", "n", "least", "most", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "flagged"), """
SELECT false AS whole, c_mktsegment, count(*) AS n, min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS median, count(*) FILTER (WHERE c_acctbal < 0) AS flagged FROM customer GROUP BY c_mktsegment
UNION ALL SELECT true, NULL, count(*), min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 4), round(quantile_cont(c_acctbal, 0.5), 4), count(*) FILTER (WHERE c_acctbal < 0) FROM customer"""),
    "nodes_bank": (lambda t: N.bank_nodes(_bank_docs(t), t["supplier"].select(F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name")), "seq"), """
SELECT 'B' || s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 10 = 0 THEN s_name ELSE upper(s_name) END AS name, CAST(CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 10 = 0 OR s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey * 100 + 1 END AS BIGINT) AS shares,
  CAST(CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 10 = 0 THEN 0 ELSE s_suppkey * 2 END AS BIGINT) AS holders, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 10 <> 0 THEN round(s_acctbal / 10000, 4) END AS stress FROM supplier"""),
    "nodes_company": (lambda t: N.company_nodes(_company_docs(t), "cin", "seq"), """
SELECT 'C' || o_custkey AS cin, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS sector, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS status FROM orders GROUP BY o_custkey"""),
    "nodes_industry": (lambda t: N.industry_nodes(t["part"].select(F.col("p_type").alias("code"), F.col("p_name").alias("name"), "p_partkey"), "p_partkey"), "SELECT p_type AS code, arg_min(p_name, p_partkey) AS name FROM part GROUP BY p_type"),
    "nodes_priority_sector": (lambda t: N.priority_sector_nodes(t.items.select("bank", _sector(F.col("priority")).alias("category"))), sql(f"""
, x AS (SELECT CASE priority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTOR_OF.items())} END AS category, count(DISTINCT bank) AS banks FROM fac GROUP BY 1)
SELECT c.category, name, coalesce(banks, 0) AS banks FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in N.PRIORITY_SECTORS.items()) + ") c(category, name) LEFT JOIN x ON x.category = c.category", "fac")),
    "nodes_shareholder": (lambda t: N.shareholder_nodes(holdings(t), resolved(t), "seq"), sql(_HOLD + """
SELECT raw AS name, arg_min(category, (owner, bank)) AS category FROM h WHERE raw NOT IN (SELECT raw FROM k) GROUP BY raw""", "holds")),
    "edge_ownership_typed": (lambda t: N.ownership_edges(holdings(t), resolved(t), _targets(t), "seq"), sql(_HOLD + """
, o AS (SELECT coalesce(kind, 'Shareholder') AS src_kind, coalesce(entity, h.raw) AS src, dst_kind, dst, pct, shares, owner, bank FROM h LEFT JOIN k ON k.raw = h.raw),
g AS (SELECT 'Bank' AS kind, 'b' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'Company', 'c' || c_custkey FROM customer)
SELECT src_kind, src, dst_kind, dst, arg_max(pct, (owner, bank, pct, shares)) AS pct, arg_max(shares, (owner, bank, pct, shares)) AS shares FROM o JOIN g ON g.kind = dst_kind AND g.node = dst WHERE src_kind <> dst_kind OR src <> dst GROUP BY ALL""", "holds")),
    "edge_lends_stubs": (lambda t: N.lender_edges(loans(t), resolved(t))[0], sql(_LOANS + """
SELECT CASE WHEN old THEN 'Company' ELSE 'Bank' END AS lender_kind, CASE WHEN old THEN stub ELSE own END AS lender, borrower, amount, round(amount / sum(amount) OVER (PARTITION BY borrower), 6) AS transmittance FROM b WHERE raw IS NOT NULL""", "lends")),
    "stubs_lender": (lambda t: N.lender_edges(loans(t), resolved(t))[1], sql(_LOANS + "\nSELECT DISTINCT stub AS cin, raw AS name FROM b WHERE old", "lends")),
    "stubs_party": (lambda t: N.party_stubs(t.rpt.select("bank", F.when(F.col("company") % 3 == 0, F.concat(F.lit("Party "), (F.col("company") % 50).cast("string"))).otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("company").cast("string"), 9, "0"))).alias("raw"), F.col("company").alias("seq")), resolved(t), "seq"), sql("""
, p AS (SELECT bank, 'Party ' || (company % 50) AS name, min(company) AS seq FROM rpt WHERE company % 3 = 0 GROUP BY ALL)
SELECT 'RPT_' || bank || '_' || lpad(CAST(row_number() OVER (PARTITION BY bank ORDER BY seq, lower(name)) AS VARCHAR), 4, '0') AS cin, bank, name FROM p""", "rpt")),
    "edge_subsidiary": (lambda t: N.subsidiaries(_owned(t), t.items.groupBy("bank").agg((F.sum("amt") / 1e8).alias("tier1")).where("bank % 3 <> 0"), "seq").select("company", "bank", "n", "relation", *[F.round(c, 9).alias(c) for c in ("cash_in", "cash_out", "contingent")], "up", "down"), sql("""
, d AS (SELECT *, CASE WHEN flag = 'R' THEN 'cash_out' WHEN flag = 'A' THEN 'cash_in' WHEN status = 'F' THEN 'contingent' ELSE 'unknown' END AS direction FROM fac WHERE company % 5 = 0),
s AS (SELECT company, bank, count(*) AS n, arg_max(priority, l_orderkey) AS relation, coalesce(sum(amt) FILTER (WHERE direction = 'cash_in'), 0.0) AS cash_in, coalesce(sum(amt) FILTER (WHERE direction = 'cash_out'), 0.0) AS cash_out,
  coalesce(sum(gross) FILTER (WHERE direction = 'cash_out'), 0.0) AS approved, coalesce(sum(amt) FILTER (WHERE direction = 'contingent'), 0.0) AS contingent FROM d GROUP BY ALL), b AS (SELECT bank, sum(amt) / 1e8 AS tier1 FROM fac WHERE bank % 3 <> 0 GROUP BY bank)
SELECT company, s.bank AS bank, n, relation, round(cash_in / 1e7, 9) AS cash_in, round(cash_out / 1e7, 9) AS cash_out, round(contingent / 1e7, 9) AS contingent, round(cash_in / 1e7 / tier1, 8) AS up, CASE WHEN approved > 0 THEN round(least(cash_out / approved, 1.0), 6) END AS down
FROM s LEFT JOIN b ON b.bank = s.bank""", "fac")),
    "node_kinds": (lambda t: t["customer"].select("c_custkey", N.node_kind(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Company"), F.lit("Bank"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("Shareholder"), F.lit("Industry"))).otherwise(F.array(F.lit("x")))).alias("kind")), "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Industry' ELSE 'Other' END AS kind FROM customer"),
    "node_names": (lambda t: t["customer"].select("c_custkey", N.display_name(F.create_map(F.lit("title"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("T"), F.lit("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))), F.when(F.col("c_custkey") % 5 > 0, F.array(F.lit("Company"))), F.col("c_custkey")).alias("name")), """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 1 THEN 'T' ELSE CASE WHEN c_custkey % 5 > 0 THEN 'Company ' ELSE 'Node ' END || c_custkey END AS name FROM customer"""),
    "bank_search": (lambda t: N.bank_list(t["supplier"].select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name")), "LIER#00000000"), "SELECT 'S' || s_suppkey AS symbol, s_name AS name FROM supplier WHERE contains(lower(s_name), 'lier#00000000')"),
    "score_updates": (lambda t: N.match_updates(t["customer"].select(F.col("c_custkey").alias("k"), F.floor(F.col("c_acctbal") / 1000).alias("v")), t["supplier"].select(F.col("s_suppkey").alias("k"), F.lit(3).cast("bigint").alias("v")), "k", "v"), """
SELECT count(*) AS asked, count(s_suppkey) AS matched, count(*) FILTER (WHERE s_suppkey IS NOT NULL AND floor(c_acctbal / 1000) <> 3) AS modified FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""),
    "sector_taxonomy_spread": (lambda t: S.spread(taxonomy(t), sector_scores(t)), _WITH(_SCORES + " SELECT industry, x.macro AS macro, score FROM x LEFT JOIN s ON s.macro = x.macro UNION ALL SELECT '', 'Unclassified', NULL")),
    "industries_by_sector": (_by_sector, f"""
WITH x(industry, macro, i) AS (VALUES {_INDUSTRIES}), p AS (SELECT p_partkey % 160 AS i, p_retailprice FROM part)
SELECT coalesce(macro, 'Unclassified') AS macro, count(*) AS n, count(DISTINCT industry) AS industries FROM p LEFT JOIN x ON x.i = p.i GROUP BY 1"""),
    "company_sector_score": (lambda t: S.of_industry(t["part"].select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("industry")), taxonomy(t), sector_scores(t), "score").select("p_partkey", "macro", "score"), _WITH(_SCORES + " SELECT p_partkey, x.macro AS macro, score FROM part JOIN x ON x.industry = p_type || ' ' || p_brand LEFT JOIN s ON s.macro = x.macro")),
    "top_sectors": (lambda t: S.top_sectors(taxonomy(t).join(sector_scores(t), "macro"), "score", 10), _WITH(_SCORES + " SELECT x.macro AS macro, min(industry) AS industry, any_value(score) AS score FROM x JOIN s ON s.macro = x.macro GROUP BY x.macro ORDER BY score DESC, macro LIMIT 10")),
    "score_replies": (_replies, """
SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 < 2 THEN round(least(c_custkey % 30 / 20, 1.0), 4) ELSE 0.5 END AS DOUBLE) AS score,
  CASE WHEN c_custkey % 4 < 2 THEN 'r' || c_custkey WHEN c_custkey % 4 = 2 THEN 'none' ELSE 'Parse error' END AS reasoning FROM customer"""),
    "dry_scores": (lambda t: t["nation"].select("n_name", S.dry_score(F.col("n_name")).alias("score")), f"SELECT n_name, {_DRY.format('n_name')} AS score FROM nation"),
    "section_summary": (lambda t: S.by_section(M.code_ranges(t["part"].select(F.format_string("%03d", "p_size").alias("code"), F.floor("p_retailprice").cast("double").alias("v")), "code", t.spark.createDataFrame([("A", "001", "003"), ("C", "010", "033")], "section string, lo string, hi string")), "section", "v"), """
WITH p AS (SELECT CASE WHEN p_size BETWEEN 1 AND 3 THEN 'A' WHEN p_size BETWEEN 10 AND 33 THEN 'C' ELSE 'Unmapped' END AS section, floor(p_retailprice) AS v FROM part)
SELECT section, count(*) AS n, sum(v) AS total, round(sum(v) / (SELECT sum(v) FROM p), 6) AS share FROM p GROUP BY section"""),
    "facility_buckets": (lambda t: S.by_bucket(_facilities(t)).select("bank", "bucket", "amount", "n", F.array_join(F.transform(F.map_entries("facilities"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(20,0)").cast("string"))), ";").alias("facilities")), sql("""
, f AS (SELECT bank, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'Term Loans' WHEN priority = '3-MEDIUM' THEN 'Working Capital' ELSE 'Uncategorized' END AS bucket, priority, sum(amt) AS a, count(*) AS k FROM fac GROUP BY ALL)
SELECT bank, bucket, sum(a) AS amount, CAST(sum(k) AS BIGINT) AS n, string_agg(priority || '=' || CAST(CAST(a AS DECIMAL(20,0)) AS VARCHAR), ';' ORDER BY priority) AS facilities FROM f GROUP BY ALL""", "fac")),
    "source_coverage": (lambda t: S.coverage(t["customer"].join(t["orders"].select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("traded", F.lit(True)), "c_custkey", "left"), traded=F.col("traded"), positive=F.col("c_acctbal") > 0), "SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS traded, count(*) FILTER (WHERE c_acctbal > 0) AS positive FROM customer"),
    "unmatched_sources": (lambda t: S.unmatched(t["customer"].select(F.col("c_custkey").alias("k")), "k", orders=t["orders"].select(F.col("o_custkey").alias("k")), banks=t["supplier"].select(F.col("s_suppkey").alias("k")), positive=t["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), events=t["events"].select(F.col("user_id").alias("k"))), """
SELECT 'orders' AS source, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'banks', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'positive', c_custkey FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT 'events', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"""),
    "name_predicates": (lambda t: t["part"].select("p_partkey", B.is_ticker(F.when(F.col("p_partkey") % 3 == 0, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.col("p_name"))).alias("ticker"), B.is_corporate(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" Motors"))).otherwise(F.lit("Jo Do"))).alias("corporate"), B.is_summary(F.when(F.col("p_partkey") % 5 == 0, " Grand TOTAL ").otherwise(F.col("p_name"))).alias("summary"), B.is_lender(F.when(F.col("p_partkey") % 7 == 0, " N/A ").when(F.col("p_partkey") % 7 == 1, "-").otherwise(F.col("p_name"))).alias("lender"), B.year_in(F.when(F.col("p_partkey") % 2 == 0, "FY 2023-24").otherwise("as of 31 March 1999 ")).alias("year"), B.camel(F.lit("TotalAssets")).alias("camel")), """
SELECT p_partkey, p_partkey % 3 = 0 AS ticker, p_partkey % 2 = 0 AS corporate, p_partkey % 5 = 0 AS summary, p_partkey % 7 > 1 AS lender, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2023 ELSE 1999 END AS INTEGER) AS year, 'totalAssets' AS camel FROM part"""),
    "allow_list": (lambda t: B.allowed(t["customer"].select("c_custkey", F.concat(F.upper("c_name"), F.lit(" Ltd.")).alias("name")), "name", t["customer"].where("c_acctbal > 0").select("c_name"), "c_name").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal > 0"),
}
