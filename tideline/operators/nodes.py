"""Nodes of the credit network from documents, stand-ins for names that nothing is known of, and typed ownership edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import slug
from ..functions.predicates import is_lender

# Categories of priority lending and their names.
PRIORITY_SECTORS = {
    "agriculture": "Agriculture",
    "msme": "MSME",
    "exportCredit": "Export Credit",
    "education": "Education",
    "housing": "Housing",
    "renewableEnergy": "Renewable Energy",
    "socialInfrastructure": "Social Infrastructure",
    "weakerSections": "Weaker Sections",
    "othersCategory": "Others",
    "prioritySectorTotal": "Priority Sector Total",
}
# How ids of stand-ins begin.
LENDER_STUB, PARTY_STUB = "LSTUB_", "RPT_"
# The properties that a node's name is looked for in, first to last.
NAME_KEYS = ("bankName", "crisilName", "name", "companyName", "shareholderName", "sectorName", "title", "cin", "bankSymbol")
# The unit in which amounts of related parties are told.
CRORE = 1e7


def bank_nodes(docs: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """(symbol, name, shares, holders, stress) of documents with a symbol and a name, the last of each symbol by `order`,
    and of registry banks (symbol, name) without a document, with zero holdings and no stress."""
    known = docs.where((F.col("symbol") != "") & (F.col("name") != "")).groupBy("symbol").agg(*[F.max_by(c, order).alias(c) for c in ("name", "shares", "holders", "stress")])
    seeded = registry.join(known, "symbol", "left_anti").select("symbol", "name", F.lit(0).cast("long").alias("shares"), F.lit(0).cast("long").alias("holders"), F.lit(None).cast("double").alias("stress"))
    return known.select("symbol", "name", F.coalesce("shares", F.lit(0)).cast("long").alias("shares"), F.coalesce("holders", F.lit(0)).cast("long").alias("holders"), F.col("stress").cast("double").alias("stress")).unionByName(seeded)


def company_nodes(docs: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of each other column the last value by `order` that is neither null nor empty."""
    def filled(c: str, kind: str) -> Column:
        return F.max_by(c, F.when(F.col(c) != "" if kind == "string" else F.col(c).isNotNull(), F.col(order)))

    # max_by skips rows whose order is null
    return docs.where(F.col(key) != "").groupBy(key).agg(*[filled(c, kind).alias(c) for c, kind in docs.dtypes if c not in (key, order)])


def industry_nodes(docs: DataFrame, order: str) -> DataFrame:
    """(code, name): the first name of each industry code."""
    return docs.where("code is not null").groupBy("code").agg(F.min_by("name", order).alias("name"))


def priority_sector_nodes(exposures: DataFrame) -> DataFrame:
    """(category, name, banks) of all categories of priority lending, with how many banks have an exposure (bank, category)
    in each."""
    names = F.explode(F.create_map(*[F.lit(x) for pair in PRIORITY_SECTORS.items() for x in pair]))
    rows = exposures.where(F.col("category").isin(*PRIORITY_SECTORS)).groupBy("category").agg(F.count_distinct("bank").alias("banks"))
    return exposures.sparkSession.range(1).select(names.alias("category", "name")).join(rows, "category", "left").select("category", "name", F.coalesce("banks", F.lit(0)).alias("banks"))


def shareholder_nodes(holdings: DataFrame, resolved: DataFrame, order: str) -> DataFrame:
    """(name, category) for each holder of holdings (raw, category) that resolved (raw, kind, entity) has no bank or
    company for; the category is that of its first row."""
    known = resolved.where("entity is not null").select("raw")
    return holdings.where("raw <> ''").join(known, "raw", "left_anti").groupBy(F.col("raw").alias("name")).agg(F.min_by("category", order).alias("category"))


def ownership_edges(holdings: DataFrame, resolved: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """SHAREHOLDER_OF edges (src_kind, src, dst_kind, dst, pct, shares) from banks, companies or shareholders to banks or
    companies: holdings (raw, dst_kind, dst, pct, shares) with what their holders resolve to (raw, kind, entity). A holder
    that resolves to nothing is a shareholder by its name; nothing holds itself. Of holdings of one pair the last by `order`
    stands, and those in what is no node of `targets` (kind, node) go."""
    known = resolved.where("entity is not null").select("raw", "kind", "entity")
    rows = holdings.where("raw <> ''").join(known, "raw", "left").select(F.coalesce("kind", F.lit("Shareholder")).alias("src_kind"), F.coalesce("entity", "raw").alias("src"), "dst_kind", "dst", F.struct(order, "pct", "shares").alias("h"))
    nodes = targets.select(F.col("kind").alias("dst_kind"), F.col("node").alias("dst"))
    last = rows.where("src_kind <> dst_kind or src <> dst").groupBy("src_kind", "src", "dst_kind", "dst").agg(F.max("h").alias("h"))
    return last.join(nodes, ["dst_kind", "dst"], "left_semi").select("src_kind", "src", "dst_kind", "dst", "h.pct", "h.shares")


def lender_edges(loans: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LENDS_TO edges of companies' loans (borrower, lender, amount), and the stand-ins among their lenders.

    Edges are (lender_kind, lender, borrower, amount, transmittance), the last one being the share of all the borrower
    owes. Names that stand for no lender go. A lender that resolves to nothing is a company with an id made of its name."""
    pairs = loans.where(is_lender(F.col("lender"))).groupBy("borrower", F.trim("lender").alias("raw")).agg(F.sum("amount").alias("amount"))
    pairs = pairs.withColumn("total", F.sum("amount").over(Window.partitionBy("borrower")))
    known = resolved.where("entity is not null").select("raw", "kind", "entity")
    every = pairs.join(known, "raw", "left").withColumn("stub", F.concat(F.lit(LENDER_STUB), slug(F.col("raw"))))
    edges = every.groupBy(F.coalesce("kind", F.lit("Company")).alias("lender_kind"), F.coalesce("entity", "stub").alias("lender"), "borrower").agg(F.sum("amount").alias("amount"), F.max("total").alias("total"))
    stubs = every.where("entity is null").groupBy(F.col("stub").alias("cin")).agg(F.min("raw").alias("name"))
    return edges.select("lender_kind", "lender", "borrower", "amount", F.round(F.try_divide("amount", "total"), 6).alias("transmittance")), stubs


def party_stubs(parties: DataFrame, resolved: DataFrame, order: str, candidates: DataFrame | None = None) -> DataFrame:
    """(cin, bank, name) for counterparties (bank, raw) that resolve to nothing, numbered within their bank by their first
    row; names that differ in case only are one. With candidates (raw, rank, known, entity, score) also top_candidates, what
    the name might be: known, entity and score, joined by colons, by rank."""
    known = resolved.where("entity is not null").select("raw")
    first = parties.where("raw <> ''").join(known, "raw", "left_anti").groupBy("bank", F.lower("raw").alias("low")).agg(F.min(F.struct(order, "raw")).alias("at"))
    n = F.row_number().over(Window.partitionBy("bank").orderBy(f"at.{order}", "low"))
    stubs = first.select(F.concat(F.lit(PARTY_STUB), F.col("bank").cast("string"), F.lit("_"), F.lpad(n.cast("string"), 4, "0")).alias("cin"), "bank", F.col("at.raw").alias("name"))
    if candidates is None:
        return stubs
    told = F.concat_ws(":", "known", "entity", F.col("score").cast("int").cast("string"))
    top = candidates.groupBy(F.col("raw").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", told.alias("told")))), lambda x: x["told"]).alias("top_candidates"))
    return stubs.join(top, "name", "left").select("cin", "bank", "name", F.coalesce("top_candidates", F.array().cast("array<string>")).alias("top_candidates"))


def subsidiaries(transactions: DataFrame, tier1: DataFrame, order: str) -> DataFrame:
    """SUBSIDIARY_OF edges of transactions (company, bank, direction, relation, approved, outstanding): how many, the last
    relation by `order`, sums by direction in ten millions (transactions of unknown direction add to none), and weights: up,
    what came in by the bank's tier 1 capital (bank, tier1); down, what went out by what was approved for that, 1 at most. A
    weight without a base is null."""
    of = lambda d, c: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col(c))), F.lit(0.0))
    sums = transactions.groupBy("company", "bank").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("relation", order).alias("relation"), of("cash_in", "outstanding").alias("cash_in"), of("cash_out", "outstanding").alias("cash_out"), of("cash_out", "approved").alias("approved"), of("contingent", "outstanding").alias("contingent"),
    )
    up = F.when(F.col("tier1") > 0, F.round(F.col("cash_in") / CRORE / F.col("tier1"), 8))
    down = F.when(F.col("approved") > 0, F.round(F.least(F.col("cash_out") / F.col("approved"), F.lit(1.0)), 6))
    return sums.join(tier1, "bank", "left").select("company", "bank", "n", "relation", *[(F.col(c) / CRORE).alias(c) for c in ("cash_in", "cash_out", "contingent")], up.alias("up"), down.alias("down"))


def node_kind(labels: Column) -> Column:
    """Bank, Company, Industry, PrioritySector or Shareholder, the first that an array of labels has; else Other."""
    out = F.lit("Other")
    for kind in ("Shareholder", "PrioritySector", "Industry", "Company", "Bank"):
        out = F.when(F.array_contains(labels, kind), kind).otherwise(out)
    return out


def display_name(props: Column, labels: Column, node: Column) -> Column:
    """What a node is called: the first of its properties (a map) that are names and not blank, else its first label, or
    Node, and its id."""
    names = [F.when(F.trim(v) != "", v) for v in (F.try_element_at(props, F.lit(k)) for k in NAME_KEYS)]
    return F.coalesce(*names, F.concat(F.coalesce(F.get(labels, F.lit(0)), F.lit("Node")), F.lit(" "), node.cast("string")))


def bank_list(banks: DataFrame, search: str | None = None) -> DataFrame:
    """(symbol, name) of banks, by name in the order of the Unicode collation; with `search` those whose name or symbol
    contains it, in any case."""
    if search:
        q = search.lower()
        banks = banks.where(F.lower("name").contains(q) | F.lower("symbol").contains(q))
    return banks.select("symbol", "name").orderBy(F.collate("name", "UNICODE"), "symbol")


def match_updates(scores: DataFrame, nodes: DataFrame, key: str, value: str) -> DataFrame:
    """How many scores (key, value) there are, how many have a node (key, value), and how many change its value."""
    old = nodes.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_there"))
    rows = scores.select(key, value).join(old, key, "left")
    return rows.agg(F.count(F.lit(1)).alias("asked"), F.count("_there").alias("matched"), F.count_if(F.col("_there") & ~F.col(value).eqNullSafe(F.col("_old"))).alias("modified"))
