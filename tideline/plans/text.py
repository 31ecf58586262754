"""Names, texts, joins of sets, and models that SQL doesn't express, over the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.metrics import metric_name
from ..operators import kernels as K
from ..operators import matching as M
from ..operators import scoring as S
from ..operators.order import numbered
from ..operators.shared import shared_path
from ..sources import extract, sheets
from ..sources.versions import Versions
from ..streaming import status
from . import scores, stages
from .views import Tables, sql

# Sections of the industry classification by the first three characters of a code, and their names.
SECTIONS = [
    ("A", "011", "033", "Agriculture, forestry and fishing"),
    ("B", "051", "099", "Mining and quarrying"),
    ("C", "101", "332", "Manufacturing"),
    ("D", "351", "354", "Electricity, gas, steam and air conditioning supply"),
    ("E", "360", "390", "Water supply; sewerage, waste management and remediation activities"),
    ("F", "410", "439", "Construction"),
    ("G", "461", "479", "Wholesale and retail trade"),
    ("H", "491", "533", "Transportation and storage"),
    ("I", "551", "564", "Accommodation and food service activities"),
    ("J", "581", "603", "Publishing, broadcasting, and content distribution activities"),
    ("K", "611", "639", "Telecommunications, computer programming, consultancy, computing infrastructure, and other information service activities"),
    ("L", "641", "663", "Financial and insurance activities"),
    ("M", "681", "682", "Real estate activities"),
    ("N", "691", "750", "Professional, scientific and technical activities"),
    ("O", "771", "829", "Administrative and support service activities"),
    ("P", "841", "843", "Public administration and defence; compulsory social security"),
    ("Q", "851", "856", "Education"),
    ("R", "861", "889", "Human health and social work activities"),
    ("S", "901", "932", "Arts, sports and recreation"),
    ("T", "941", "969", "Other service activities"),
    ("U", "970", "982", "Activities of households as employers; undifferentiated goods- and services-producing activities of households for own use"),
    ("V", "990", "990", "Activities of extraterritorial organizations and bodies"),
]
_SECTION = "section string, lo string, hi string, sector string"
_SECTIONS = ", ".join(str(s) for s in SECTIONS)
VARIANTS = [("ring", "RNG"), ("small ring", "SRG"), ("bolt", "BLT"), ("blue bolt", "BBT"), ("widget", "WDG"), ("red", "RED")]
_CASE = " ".join(f"WHEN contains(lower(p_name), '{n}') THEN '{s}'" for n, s in sorted(VARIANTS, key=lambda v: (-len(v[0]), v[0]), reverse=False))


def _code_scores(t: Tables):
    a = t["customer"].where("c_acctbal > 0").select(F.concat(F.lit(" "), F.lower("c_name")).alias("code"), F.col("c_acctbal").alias("news"))
    b = t["customer"].where("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("code"), F.col("c_nationkey").cast("double").alias("fundamental"))
    return M.full_outer_scores(a, b, "code")


def _odd(c: str):
    """Names with other spellings in them."""
    return F.concat(F.when(F.col("c_custkey") % 2 == 0, "M/s. ").otherwise("The "), F.col(c), F.when(F.col("c_custkey") % 3 == 0, " Pvt. Ltd.").otherwise(" & Co (India)"))


_ODD = "concat(CASE WHEN c_custkey % 2 = 0 THEN 'M/s. ' ELSE 'The ' END, c_name, CASE WHEN c_custkey % 3 = 0 THEN ' Pvt. Ltd.' ELSE ' & Co (India)' END)"
_WORDS = "|".join(X.LEGAL_WORDS)


def _names(t: Tables):
    """Part names as companies, misspelt ones, and banks."""
    known = t["part"].select(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" Limited")).alias("known"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("entity"))
    asked = t["part"].select(F.concat(F.initcap("p_name"), F.lit("s "), "p_brand", F.lit(" Ltd")).alias("name"))
    banks = t["supplier"].select(F.col("s_name").alias("known"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("entity"))
    return M.resolve(asked, "name", banks, known)


def _reports(t: Tables):
    """A report of each bank made of its pairs: a total, its segments as categories, and companies as entities of two axes."""
    row = t.pairs.join(t["customer"].select(F.col("c_custkey").alias("company"), "c_mktsegment"), "company").select("bank", "company", F.col("n"), F.regexp_replace("c_mktsegment", " ", "").alias("segment"))
    member = lambda axis, value: F.concat(F.lit(f'<d:explicitMember dimension="in:{axis}">in:'), value, F.lit("</d:explicitMember>"))
    context = lambda i, inner: F.concat(F.lit('<x:context id="'), i, F.lit('"><x:entity><x:segment>'), inner, F.lit("</x:segment></x:entity><x:period><x:instant>2024-03-31</x:instant></x:period></x:context>"))
    fact = lambda i, value: F.concat(F.lit('<in:NumberOfShares contextRef="'), i, F.lit('">'), value.cast("string"), F.lit("</in:NumberOfShares>"))

    def one(e: Column) -> Column:
        who = F.concat(F.lit("E"), e["company"].cast("string"))
        return F.concat(context(who, F.concat(member(extract.CATEGORY_AXIS, F.col("segment")), member("DetailsOfHoldersAxis", who), F.when(e["company"] % 2 == 0, member("DetailsOfTrustsAxis", F.lit("Trust"))).otherwise(""))), fact(who, e["n"]))

    # numbers are gathered, and texts made of them afterwards
    parts = row.groupBy("bank", "segment").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("company", "n"))).alias("e")).select("bank", "segment", "n", F.array_join(F.transform("e", one), "").alias("entities"))
    of = F.concat(F.lit("C"), F.col("segment"))
    body = F.concat("entities", context(of, member(extract.CATEGORY_AXIS, F.col("segment"))), fact(of, F.col("n")))
    whole = parts.groupBy("bank").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(body)), "").alias("body"))
    xml = F.concat(F.lit('<x:xbrl xmlns:x="u" xmlns:d="v" xmlns:in="w">'), "body", context(F.lit("MainI"), F.lit("")), fact(F.lit("MainI"), F.col("n")), F.lit("</x:xbrl>"))
    return extract.xbrl_facts(whole.select("bank", xml.alias("xml")), "bank", "xml")


def _versions(t: Tables):
    """Orders by their statuses: half are loaded, the others inserted; then some are updated, unset and deleted."""
    table = Versions(t.spark, shared_path(t.spark, "orders"), "k long, status string, priority string", "k")
    rows = t["orders"].select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    table.replace(rows.where("k % 2 = 0"))
    table.insert(rows, chunk=100000)
    table.update(rows.where("k % 3 = 0").select("k", F.lit("late").alias("status")))
    table.unset(rows.where("k % 5 = 0"), "priority")
    table.delete(rows.where("k % 7 = 0"))
    return table.read()


def _sheets(t: Tables):
    """Sheets of each nation's banks as cells: a title, the header with metrics over two years each, the years, banks, a total."""
    s = t["supplier"].select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("file"), "s_suppkey", "s_name", "s_acctbal")
    texts = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x).cast("string") for x in xs])
    cell = lambda c: F.format_number(F.floor(c), 0)
    rows = [(0, texts("Table 4", None)), (1, texts("No.", "Banks", "gross NPA#", None, "Net  Profit", None)), (2, texts(None, None, "FY 2022", "FY 2023", "2022", "31-03-2023")), (1 << 30, texts(None, "Grand Total", "1", "2", "3", "4"))]
    heads = s.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), r.alias("cells")) for n, r in rows])).alias("r")).select("file", F.lit("").alias("sheet"), "r.n", "r.cells")
    last = F.when(F.col("s_suppkey") % 4 == 0, "-").otherwise(cell(F.col("s_suppkey") * 2023))
    return heads.unionByName(s.select("file", F.lit("").alias("sheet"), (F.col("s_suppkey") + 2).cast("int").alias("n"), texts("1", F.concat(F.col("s_name"), F.lit(" ")), cell(F.col("s_acctbal") + 2022), cell(F.col("s_acctbal") + 2023), cell(F.col("s_suppkey") * 2022), last).alias("cells")))


def _staged(t: Tables):
    """Companies' blends by way of stages: what each is made of, then the blend of all three."""
    customers = f"{t.sf_dir}/customer.parquet"
    part = lambda c: stages.Stage(c, lambda _: scores.parts(t).select("company", c), sources=(customers,))

    def blend(inputs):
        f, n, s = (inputs[c] for c in ("fundamental", "news", "sector"))
        rows = f.join(n, "company").join(s, "company")
        return rows.select("company", F.round(S.company_blend(F.col("fundamental"), F.col("news"), F.col("sector")), 6).alias("stress"))

    run = stages.Run(t.spark, shared_path(t.spark, "stages"), [part("fundamental"), part("news"), part("sector"), stages.Stage("company_stress", blend, ("fundamental", "news", "sector"))])
    told = run.run("companies", {"companies": ("company_stress",)})
    if told["company_stress"] != "done":
        raise RuntimeError(str(told))
    return run.read("company_stress")


def _oriented(t: Tables):
    """Banks by the components of their ratios' health, and by the rank of their balance, which seven in eight have."""
    health = scores.ratios(t).select("bank", *[S.health(r, F.col(r)).alias(r) for r in scores.RATIOS])
    ranks = numbered(t["supplier"].where("s_suppkey % 8 <> 0").select(F.lit(0).alias("all"), F.col("s_suppkey").alias("bank"), "s_acctbal"), ["all"], ["s_acctbal", "bank"], "rank").select("bank", (F.col("rank") + 1).alias("rank"))
    parts = K.kernel_components(health, "bank", list(scores.RATIOS), [0.2] * len(scores.RATIOS)).join(ranks, "bank", "left")
    return K.oriented_stress(parts, "bank", [f"pc{k + 1}" for k in range(K.COMPONENTS)], "rank").select("bank", F.round("oriented", 4).alias("oriented"))


_ROWS = ", r AS (SELECT bank, company, n, replace(c_mktsegment, ' ', '') AS segment FROM lends JOIN customer ON c_custkey = company)"


Q: dict = {
    "report_facts": (lambda t: extract.route_facts(_reports(t), "bank").where("member is null or member <> 'Trust'").select("bank", "part", "axis", "member", "name", F.col("number").cast("long").alias("number")), sql(_ROWS + """
SELECT bank, 'total' AS part, CAST(NULL AS VARCHAR) AS axis, CAST(NULL AS VARCHAR) AS member, 'numberOfShares' AS name, CAST(sum(n) AS BIGINT) AS number FROM r GROUP BY bank
UNION ALL SELECT bank, 'aggregate', 'CategoryOfShareholdersAxis', segment, 'numberOfShares', CAST(sum(n) AS BIGINT) FROM r GROUP BY bank, segment
UNION ALL SELECT bank, 'entity', 'DetailsOfHoldersAxis', 'E' || company, 'numberOfShares', n FROM r""", "lends")),
    "report_figures": (lambda t: extract.report_figures(_reports(t), "bank").select("bank", "end", F.col("shares").cast("long").alias("shares"), "holders", "categories", "entities"), sql(_ROWS + """
SELECT bank, '2024-03-31' AS end, CAST(sum(n) AS BIGINT) AS shares, CAST(NULL AS DOUBLE) AS holders, count(DISTINCT segment) AS categories, count(*) + CAST(bool_or(company % 2 = 0) AS BIGINT) AS entities FROM r GROUP BY bank""", "lends")),
    "table_versions": (_versions, """
WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 7 <> 0) SELECT * FROM v"""),
    # sheets of each nation, with a line above the header and totals below the banks
    "sheet_metrics": (lambda t: sheets.bank_metrics(_sheets(t)).select("file", "bank", "metric", "year", "value"), """
SELECT 'n' || s_nationkey AS file, s_name AS bank, m AS metric, y AS year, floor(CASE m WHEN 'Gross NPA' THEN s_acctbal + y ELSE s_suppkey * y END) AS value
FROM supplier, (VALUES ('Gross NPA'), ('Net Profit')) a(m), (VALUES (2022), (2023)) b(y) WHERE NOT (m = 'Net Profit' AND y = 2023 AND s_suppkey % 4 = 0)"""),
    "staged_blend": (_staged, scores.Q["company_blend"][1]),
    "scores_full_outer": (_code_scores, """
WITH a AS (SELECT upper(trim(' ' || lower(c_name))) AS code, c_acctbal AS news FROM customer WHERE c_acctbal > 0), b AS (SELECT upper(c_name) AS code, CAST(c_nationkey AS DOUBLE) AS fundamental FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(a.code, b.code) AS code, news, fundamental FROM a FULL JOIN b ON a.code = b.code"""),
    "unmatched_anti": (lambda t: t["customer"].join(t.lends, F.col("c_custkey") == F.col("company"), "left_anti").select("c_custkey", "c_name"), sql("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT company FROM lends)", "lends")),
    "resume_anti": (lambda t: t["orders"].select("o_custkey").distinct().join(t["customer"].where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "nic_range_join": (lambda t: M.code_ranges(t["part"].select("p_partkey", F.format_string("%05d", F.col("p_partkey") * 37 % 100000).alias("code")), "code", t.spark.createDataFrame(SECTIONS, _SECTION)), f"""
WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey * 37 % 100000 AS VARCHAR), 5, '0') AS code FROM part)
SELECT p_partkey, code, section, sector FROM p LEFT JOIN (VALUES {_SECTIONS}) s(section, lo, hi, sector) ON left(code, 3) BETWEEN lo AND hi"""),
    "longest_substring_join": (lambda t: t["part"].select("p_partkey", M.longest_contained(t["part"], "p_name", VARIANTS).alias("symbol")), f"SELECT p_partkey, CASE {_CASE} END AS symbol FROM part"),
    "bank_name_join": (lambda t: M.bank_name_join(t["supplier"].select("s_suppkey", F.concat(F.lower("s_name"), F.lit(" Ltd.")).alias("x")), "x", t["supplier"].select(F.col("s_name").alias("y"), F.col("s_acctbal").alias("tier1")), "y").select("s_suppkey", "tier1"), "SELECT s_suppkey, s_acctbal AS tier1 FROM supplier"),
    "boards_union": (lambda t: t["supplier"].select(F.col("s_name").alias("name")).union(t["customer"].select(F.when(F.col("c_acctbal") > 0, F.col("c_name")))).dropna(), "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer WHERE c_acctbal > 0"),
    "rating_union": (lambda t: t.fac.select("company", F.col("facility").alias("item")).union(t["customer"].select("c_custkey", "c_mktsegment")).groupBy("company").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("item").alias("kinds")), sql("""
SELECT company, count(*) AS items, count(DISTINCT item) AS kinds FROM (SELECT company, facility AS item FROM fac UNION ALL SELECT c_custkey, c_mktsegment FROM customer) GROUP BY company""", "fac")),
    "norm_company": (lambda t: t["customer"].select("c_custkey", X.company_key(_odd("c_name")).alias("key")), f"""
SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower({_ODD}), '[&\\-–,.()/\\\\]+', ' ', 'g'), '\\b({_WORDS})\\b\\.?', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM customer"""),
    "slugify": (lambda t: t["customer"].select("c_custkey", X.slug(_odd("c_name"), 20).alias("slug")), f"SELECT c_custkey, substr(regexp_replace(regexp_replace(lower(trim({_ODD})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20) AS slug FROM customer"),
    "ascii_sanitize": (lambda t: t["documents"].select("doc_id", F.sha2(X.ascii_text(F.coalesce("text", F.lit(""))), 256).alias("sha")), """
SELECT doc_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '–', '-'), '—', '-'), '‘', ''''), '’', ''''), '“', '"'), '”', '"'), '…', '...'), '₹', 'Rs.'), chr(160), ' '), '[^\\x00-\\x7F]', '', 'g'))) AS sha FROM documents"""),
    "scoring_texts": (lambda t: t["documents"].select("doc_id", F.substring(F.concat(F.coalesce("source", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))), 1, 450).alias("snippet")), "SELECT doc_id, substr(coalesce(source, '') || '. ' || coalesce(text, ''), 1, 450) AS snippet FROM documents"),
    "as_of_filter": (lambda t: t["events"].where(F.to_date("ts") <= F.lit("2024-01-10")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-10' GROUP BY event_type"),
    "date_parse": (lambda t: t["orders"].select("o_orderkey", X.date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))).cast("string").alias("d")), "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders"),
    "number_clean": (lambda t: t["orders"].select("o_orderkey", X.number(F.when(F.col("o_orderkey") % 7 == 0, "-").when(F.col("o_orderkey") % 7 == 1, "NA").otherwise(F.format_number(F.floor("o_totalprice"), 0))).alias("x")), "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN floor(o_totalprice) END AS x FROM orders"),
    "json_props": (lambda t: t["events"].select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY k"),
    "confidence_bands": (lambda t: t["events"].groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).select("user_id", S.confidence(F.col("n")).alias("confidence"), S.news_band(F.col("n") / 10).alias("band")), "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 5 THEN 'high' WHEN count(*) FILTER (WHERE event_type = 'error') >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 8 THEN 'Severe' WHEN count(*) FILTER (WHERE event_type = 'error') >= 6 THEN 'High' WHEN count(*) FILTER (WHERE event_type = 'error') >= 4 THEN 'Moderate' WHEN count(*) FILTER (WHERE event_type = 'error') >= 2 THEN 'Low' ELSE 'Minimal' END AS band FROM events GROUP BY user_id"),
    "status_queue": (lambda t: status.latest_status(t["events"].select(F.col("user_id").alias("report"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))), "SELECT user_id AS report, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY user_id"),
    "fuzzy_resolve": (_names, None),
    "exchange_match": (lambda t: M.exchange_match(t["supplier"].select("s_suppkey", F.concat("s_name", F.lit(" Limited")).alias("name"), F.concat(F.lit("The "), "s_name").alias("other")), "s_suppkey", ["name", "other"], t["supplier"].where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"), F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " Ltd.").otherwise("")).alias("known"))).select("s_suppkey", "match", "confidence"), None),
    "metric_names": (lambda t: t["part"].select("p_partkey", metric_name(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Net NPA as %*  of "), "p_name")).when(F.col("p_partkey") % 4 == 1, F.lit(" gross\nNPA# ")).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(" car ratio"))).otherwise(F.col("p_name"))).alias("metric")), """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Net NPA as % to Net Advances' WHEN 1 THEN 'Gross NPA' WHEN 2 THEN 'Capital Adequacy Ratio (Basel-III)' ELSE
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS metric FROM part"""),
    "merton_dtd": (lambda t: t["supplier"].where("s_acctbal > 0").select("s_suppkey", K.merton(F.col("s_acctbal"), F.lit(0.2) + (F.col("s_suppkey") % 10) / 20, F.col("s_acctbal") * 4).alias("m")).select("s_suppkey", *[F.round(f"m.{c}", 4).alias(c) for c in ("asset_value", "asset_vol", "dtd", "default_probability")], "m.converged"), None),
    "kernel_pca": (lambda t: K.boundary_stress(scores.ratios(t).select("bank", *[S.health(r, F.col(r)).alias(r) for r in scores.RATIOS]), "bank", list(scores.RATIOS), [0.2] * len(scores.RATIOS)).select("bank", F.round("boundary", 4).alias("boundary")), None),
    "oriented_stress": (_oriented, None),
    "ridge_orientation": (lambda t: K.ridge_orientation(scores.ratios(t), "bank", ["totalCAR", "tier1CAR", "returnOnAssets"], "netNPAToNetAdvances").select("bank", F.round("oriented", 4).alias("oriented")), None),
    "pca_stress": (lambda t: K.pca_stress(scores.ratios(t), "bank", list(scores.RATIOS), "netNPAToNetAdvances").select("bank", F.round("score", 4).alias("score")), None),
    "html_links": (lambda t: t["pages"].select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), 0)).cast("long").alias("links"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title")), """
SELECT page_id, len(regexp_extract_all(html, '<a href="[^"]*"')) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"""),
    # the pages have no tables, so each gets one of two rows
    "html_tables": (lambda t: extract.html_tables(t["pages"].select("page_id", F.concat(F.lit("<table><tr><th>Id<th> Key </tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td><b>k</b> "), F.sha1(F.coalesce("html", F.lit("")).cast("binary")), F.lit("</td></table>"), F.coalesce("html", F.lit(""))).alias("html")), "page_id", "html").select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells")), """
SELECT page_id, CAST(0 AS INTEGER) AS table_no, CAST(r AS INTEGER) AS row_no, CASE r WHEN 0 THEN 'Id|Key' ELSE page_id || '|k ' || sha1(coalesce(html, '')) END AS cells FROM pages, (VALUES (0), (1)) v(r)"""),
}
