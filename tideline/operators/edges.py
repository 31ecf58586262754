"""Edges of the credit network from facilities and transactions, and the risk of facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import chain, lookup
from .graph_queries import joined

# Multipliers of loss and transmission categories.
LGD = {"Secured": 0.4, "Unsecured": 0.6, "Senior": 0.3, "Subordinated": 0.8}
TRANSMISSION = {"TermLoan": 0.9, "WC": 0.7, "CP": 1.2, "Guarantee": 0.3, "ECB": 0.8}
# Categories of facility buckets.
BUCKETS = {"Bills Purchased & Discounted": ("CP", "Senior"), "Cash Credits, Overdrafts & Loans": ("WC", "Secured"), "Term Loans": ("TermLoan", "Secured")}
# Words in a facility's name that set a category, the first rule that fits.
LGD_WORDS = [(("subordinated", "tier ii", "tier 2", "lower tier"), "Subordinated"), (("senior",), "Senior"), (("unsecured", "clean"), "Unsecured"), (("secured", "hypothecation", "mortgage", "pledge"), "Secured")]
T_WORDS = [(("external commercial", "ecb"), "ECB"), (("guarantee", "letter of credit", "standby", "non fund"), "Guarantee"), (("bill", "discount", "factoring", "forfaiting", "cheque purchase"), "CP"), (("working capital", "cash credit", "overdraft", "packing credit", "pre shipment", "post shipment"), "WC"), (("term loan", "rupee term", "long term"), "TermLoan")]
# Transactions that bring a bank money, take it, or may.
CASH_IN_TYPES, CASH_OUT_TYPES = ("loan", "advance", "deposit placed"), ("borrowing", "deposit accepted", "dividend paid")
CASH_IN_DETAILS, CASH_OUT_DETAILS, CONTINGENT = ("interest received", "repayment received"), ("interest paid", "rent paid"), "guarantees given"


def facility_risk(facility: Column, bucket: Column) -> Column:
    """struct of lgd_category, lgd, t_category, t: from the bucket, then words in the name, then what the transmission
    category suggests; else Unknown with 1.0."""
    name = F.lower(F.coalesce(facility, F.lit("")))

    def words(rules: list) -> Column:
        cases = []
        for any_of, category in rules:
            hit = F.lit(False)
            for w in any_of:
                hit = hit | name.contains(w)
            cases.append((hit, category))
        return chain(name, cases)

    t = F.coalesce(words(T_WORDS), lookup(bucket, {k: v[0] for k, v in BUCKETS.items()}))
    lgd = F.coalesce(words(LGD_WORDS), lookup(bucket, {k: v[1] for k, v in BUCKETS.items()}), F.when(t.isin("TermLoan", "ECB", "WC"), "Secured").when(t.isin("CP", "Guarantee"), "Senior"))
    return F.struct(F.coalesce(lgd, F.lit("Unknown")).alias("lgd_category"), F.coalesce(lookup(lgd, LGD), F.lit(1.0)).alias("lgd"), F.coalesce(t, F.lit("Unknown")).alias("t_category"), F.coalesce(lookup(t, TRANSMISSION), F.lit(1.0)).alias("t"))


def dominant(category: str) -> Column:
    """Of rows that are sums by category, the category with the largest sum, the last by name of equals."""
    return F.max_by(category, F.struct("amt", category))


def lends_bank_side(facilities: DataFrame) -> DataFrame:
    """One edge per bank and company of facilities (bank, company, facility, bucket, amt): sums, types, and multipliers
    weighted by amount; amounts of 0 or less don't count in these. One shuffle by the pair and both categories."""
    risk = facilities.withColumn("risk", facility_risk(F.col("facility"), F.col("bucket"))).select("bank", "company", "facility", "amt", "risk.*")
    part = risk.groupBy("bank", "company", "lgd_category", "t_category").agg(F.sum("amt").alias("amt"), F.count(F.lit(1)).alias("n"), F.collect_set("facility").alias("types"), F.sum(F.when(F.col("amt") > 0, F.col("amt"))).alias("basis"), F.sum(F.when(F.col("amt") > 0, F.col("amt") * F.col("lgd"))).alias("wl"), F.sum(F.when(F.col("amt") > 0, F.col("amt") * F.col("t"))).alias("wt"))
    whole = part.groupBy("bank", "company").agg(
        F.round(F.sum("amt"), 2).alias("total_amount"),
        F.sum("n").alias("facility_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",").alias("facility_types"),
        F.round(F.coalesce(F.try_divide(F.sum("wl"), F.sum("basis")), F.lit(1.0)), 6).alias("lgd_multiplier"),
        F.round(F.coalesce(F.try_divide(F.sum("wt"), F.sum("basis")), F.lit(1.0)), 6).alias("t_multiplier"),
        F.collect_list(F.struct("lgd_category", "t_category", "amt")).alias("by"),
    )

    def top(kind: str) -> Column:
        names = F.array_sort(F.array_distinct(F.col(f"by.{kind}")))
        sums = F.transform(names, lambda k: F.struct(F.aggregate("by", F.lit(0.0), lambda s, x: s + F.when(x[kind] == k, x["amt"]).otherwise(0.0)).alias("s"), k.alias("k")))
        return F.array_max(sums)["k"]

    return whole.withColumn("lgd_category", top("lgd_category")).withColumn("t_category", top("t_category")).drop("by")


def lends_company_side(facilities: DataFrame, tier1: DataFrame) -> DataFrame:
    """One edge per lender and borrower with the share of the borrower's total (transmittance) and of the lender's
    capital (absorption, at most 1); tier1 is (bank, tier1)."""
    pairs = facilities.groupBy("bank", "company").agg(F.sum("amt").alias("amount"))
    share = F.col("amount") / F.sum("amount").over(Window.partitionBy("company"))
    return pairs.withColumn("transmittance", F.round(share, 6)).join(tier1, "bank", "left").select("bank", "company", F.round("amount", 2).alias("amount"), "transmittance", F.round(F.least(F.try_divide(F.col("amount"), F.col("tier1")), F.lit(1.0)), 6).alias("absorption"))


def lends_merged(facilities: DataFrame) -> DataFrame:
    """Both sides from one table of facilities, so that none counts twice; a pair with several known categories is
    Mixed, one without any Unknown."""
    risk = facilities.withColumn("risk", facility_risk(F.col("facility"), F.col("bucket"))).select("bank", "company", "amt", "risk.*")
    known = lambda c: F.nullif(F.col(c), F.lit("Unknown"))
    one = lambda c: F.when(F.min(known(c)) < F.max(known(c)), "Mixed").otherwise(F.coalesce(F.max(known(c)), F.lit("Unknown"))).alias(c)
    return risk.groupBy("bank", "company").agg(F.round(F.sum("amt"), 2).alias("total_amount"), one("lgd_category"), one("t_category"))


def direction(kind: Column, details: Column) -> Column:
    """contingent, cash_in, cash_out or unknown: contingent details first, then the type, then the details."""
    k, d = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.trim(F.coalesce(details, F.lit(""))))
    return chain(k, [(d == CONTINGENT, "contingent"), (k.isin(*CASH_IN_TYPES), "cash_in"), (k.isin(*CASH_OUT_TYPES), "cash_out"), (d.isin(*CASH_IN_DETAILS), "cash_in"), (d.isin(*CASH_OUT_DETAILS), "cash_out")], "unknown")


def related_party(transactions: DataFrame) -> DataFrame:
    """One edge per counterparty and bank of transactions (company, bank, direction, relation, period, approved,
    outstanding): sums by direction, all relations and the most frequent one (the first by name of equals)."""
    by_rel = transactions.groupBy("company", "bank", "relation").agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.when(F.col("direction") == d, F.col("outstanding"))).alias(d) for d in ("cash_in", "cash_out", "contingent")], F.sum("approved").alias("approved"), F.collect_set("period").alias("periods"))
    sums = [F.round(F.coalesce(F.sum(d), F.lit(0.0)), 2).alias(d) for d in ("cash_in", "cash_out", "contingent")]
    return by_rel.groupBy("company", "bank").agg(
        F.sum("k").alias("txn_count"), *sums, F.round(F.sum("approved"), 2).alias("approved"),
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"),
        F.min_by("relation", F.struct(-F.col("k"), F.col("relation"))).alias("primary_relation"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("periods")))), ",").alias("periods"),
    )


def priority_exposure(facilities: DataFrame) -> DataFrame:
    """Each bank's amounts by sector and their shares of its total."""
    sums = facilities.groupBy("bank", F.col("facility").alias("sector")).agg(F.sum("amt").alias("outstanding"))
    return sums.select("bank", "sector", F.round("outstanding", 2).alias("outstanding"), F.round(F.col("outstanding") / F.sum("outstanding").over(Window.partitionBy("bank")), 6).alias("share"))


def related_summary(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("bank", "direction").agg(F.count(F.lit(1)).alias("txn_count"), F.count_distinct("company").alias("parties"), F.round(F.sum("outstanding"), 2).alias("outstanding"), joined(F.col("relation")).alias("relations"))
