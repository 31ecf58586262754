"""Graph patterns of a credit network as relational plans over typed edge frames.

lends(bank, company, amount, n), rpt(company, bank, amount, up, n), holds(owner, bank, category, pct),
bank_holds(owner, bank, pct), co_lends(lender, company), bank_rpt(a, b, parts), industry(company, name, industry).
Lists come back as sorted, comma-joined strings. Every limit has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, parts

#: Pairs that a task sums, as many lists as for how many it makes, and the most tasks; beyond them a task gets more.
TASK_PAIRS, TASK_LISTS, PAIR_TASKS = 2_000_000, 16_000_000, 10_000


def joined(values: Column) -> Column:
    """A set of values as a sorted string."""
    return F.array_join(F.array_sort(F.collect_set(values.cast("string"))), ",")


def common_owners(holds: DataFrame, least: int = 2) -> DataFrame:
    """Owners of several banks."""
    return holds.groupBy("owner").agg(F.count_distinct("bank").alias("bank_count"), joined(F.col("bank")).alias("banks")).where(F.col("bank_count") >= least)


def bank_ownership(bank_holds: DataFrame) -> DataFrame:
    return bank_holds.select(F.col("owner").alias("owner_bank"), F.col("bank").alias("target_bank"), F.col("pct").alias("stake_pct"))


def shared_borrowers(lends: DataFrame, least: int) -> DataFrame:
    """Companies with `least` lenders or more, and their exposure."""
    return lends.groupBy("company").agg(F.count_distinct("bank").alias("lender_count"), joined(F.col("bank")).alias("lenders"), F.round(F.sum("amount"), 2).alias("total_exposure")).where(F.col("lender_count") >= least)


def dual_borrowers(lends: DataFrame, industry: DataFrame, limit: int = 100) -> DataFrame:
    """One row per lender of each company with two or more, the largest exposures first."""
    two = F.min("bank") < F.max("bank")  # two lenders or more, without a set of them
    every = lends.groupBy("company").agg(F.round(F.sum("amount"), 2).alias("total_exposure"), two.alias("two")).where("two").drop("two")
    rows = lends.select("bank", "company").join(every, "company").join(industry, "company")
    return rows.select("bank", "company", "industry", "total_exposure").orderBy(F.desc("total_exposure"), "company", "bank").limit(limit)


def loans_to_related_of_other(lends: DataFrame, rpt: DataFrame) -> DataFrame:
    """Loans to a company that is a related party of another bank."""
    other = rpt.select("company", F.col("bank").alias("rpt_bank"), F.col("up").alias("rpt_exposure"))
    return lends.join(other, "company").where("bank <> rpt_bank").select(F.col("bank").alias("lending_bank"), "rpt_bank", "company", F.col("amount").alias("loan_amount"), "rpt_exposure")


def own_subsidiary_loans(lends: DataFrame, subsidiary: DataFrame) -> DataFrame:
    return lends.join(subsidiary.select("company", "bank"), ["company", "bank"]).select("bank", "company", F.col("amount").alias("loan_amount"))


def subsidiary_two_hop(lends: DataFrame, subsidiary: DataFrame) -> DataFrame:
    parent = subsidiary.select("company", F.col("bank").alias("parent_bank"))
    return lends.join(parent, "company").where("bank <> parent_bank").select("parent_bank", F.col("bank").alias("lending_bank"), "company", F.col("amount").alias("exposure"))


def borrower_holds_other(lends: DataFrame, holds: DataFrame) -> DataFrame:
    """Borrowers that own a stake in another bank."""
    stake = holds.select(F.col("owner").alias("company"), F.col("bank").alias("bank_with_stake"), F.col("pct").alias("stake_pct"))
    return lends.join(stake, "company").where("bank <> bank_with_stake").select(F.col("bank").alias("lending_bank"), "bank_with_stake", "company", F.col("amount").alias("credit_exposure"), "stake_pct")


def met_pairs(rows: DataFrame, by: str, item: str, *values: str) -> DataFrame:
    """(a, b, a_<value>, b_<value>) for every two rows of one `by` whose items differ, a below b, once; without values an item
    counts once for each `by`. Neighbouring keys are in one task, so that where they share items a sum over pairs meets most
    of a pair's rows before it is shuffled. The rows of one key are a list, of which a task has one at a time."""
    known = rows.select(by, item, *values).where(F.col(by).isNotNull() & F.col(item).isNotNull())
    listed = (F.collect_list if values else F.collect_set)(F.struct(item, *values))
    one = known.repartitionByRange(by).groupBy(by).agg(F.sort_array(listed).alias("_l")).select("_l", F.posexplode("_l").alias("_k", "_a"))
    two = one.select("_a", F.explode(F.slice("_l", F.col("_k") + 2, F.size("_l"))).alias("_b")).where(f"_a.{item} < _b.{item}")
    return two.select(F.col(f"_a.{item}").alias("a"), F.col(f"_b.{item}").alias("b"), *[F.col(f"_{side}.{v}").alias(f"{side}_{v}") for v in values for side in "ab"])


def pair_sums(rows: DataFrame, by: str, item: str, value: str | None = None) -> DataFrame:
    """(a, b, shared) for every two items (whole numbers), a below b, and how many rows of one `by` meet in them; with a value,
    a double, also the sum `least` of the smaller ones. Without, an item counts once for each `by`.

    No pair is shuffled: each row goes to the task of its item with the list of the items above it, some bytes each, and pairs
    are made and summed there. So what is shuffled grows with the pairs that are made, however they meet; sums before a shuffle
    would fill memory and disks where few pairs meet twice. Tasks are so many that the pairs of one fit in its memory. The rows
    of one `by` are a list, of which a task has one at a time."""
    known = cut(rows.select(by, item, *([value] if value else [])).where(F.col(by).isNotNull() & F.col(item).isNotNull()), "met")
    n, k = F.count(F.lit(1)), F.col("_k")
    made = known.groupBy(by).agg((n * (n - 1) / 2).alias("k")).agg(F.sum("k")).first()[0] or 0
    tasks = lambda pairs: min(PAIR_TASKS, max(known.sparkSession.sparkContext.defaultParallelism, int(made // pairs) + 1))
    # lists whose numbers all fit in four bytes go as such: `_item_s`, else `_item`
    fits = [F.bool_and(F.col(item).between(-(2**31), 2**31 - 1)).alias("_item_fits")]
    if value:
        fits.append(F.bool_and(F.col(value).cast("float").cast("double") == F.col(value)).alias("_value_fits"))
    listed = F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).alias("v"))) if value else F.collect_set(F.struct(F.col(item).alias("i")))
    lists = known.repartitionByRange(tasks(TASK_LISTS), by).groupBy(by).agg(F.sort_array(listed).alias("_l"), *fits)
    sides = [("_item", F.col("_l.i"), "int", "bigint")] + ([("_value", F.col("_l.v"), "float", "double")] if value else [])
    fit = lambda c: F.coalesce(f"{c}_fits", F.lit(False))
    lists = lists.select("_l", *[x for c, xs, small, _ in sides for x in (F.when(fit(c), xs.cast(f"array<{small}>")).alias(f"{c}_s"), F.when(~fit(c), xs).alias(c))])
    names = [x for c, *_ in sides for x in (f"{c}_s", c)]
    at = {c: (lambda i, c=c, wide=wide: F.coalesce(F.get(f"{c}_s", i).cast(wide), F.get(c, i))) for c, _, _, wide in sides}
    one = lists.select(F.size("_l").alias("_n"), *names, F.posexplode("_l").alias("_k", "_own")).where("_k + 1 < _n")
    sent = one.select(F.col("_own.i").alias("a"), *([F.col("_own.v").alias("_least")] if value else []), (F.col("_n") - k - 1).alias("_n"), *[F.slice(c, k + 2, F.col("_n")).alias(c) for c in names])
    met = sent.repartition(tasks(TASK_PAIRS), "a").select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    two = met.select("a", at["_item"](k).alias("b"), *([F.least("_least", at["_value"](k)).alias("_least")] if value else [])).where("a < b")
    return two.groupBy("a", "b").agg(n.alias("shared"), *([F.sum("_least").alias("least")] if value else []))


def related_bridge(lends: DataFrame, rpt: DataFrame, limit: int = 50) -> DataFrame:
    """Pairs of banks linked by a company that borrows from one and is a related party of the other."""
    # each side has a bank and company once, and so has what they make: nothing of it is left to group; the number of tasks
    # is given, since adaptive execution would gather sides that are small against what is made of them
    tasks = parts(lends.sparkSession)
    loans = lends.select("bank", "company").repartition(tasks, "company").groupBy("bank", "company").agg(F.count(F.lit(1)).alias("k"))
    other = rpt.select("company", F.col("bank").alias("rpt_bank"), "n").repartition(tasks, "company").groupBy("rpt_bank", "company").agg(F.sum("n").alias("n"))
    found = loans.join(other, "company").where("bank <> rpt_bank").select(F.col("bank").alias("lending_bank"), "rpt_bank", "company", (F.col("k") * F.col("n")).alias("rpt_count"))
    return found.orderBy(F.desc("rpt_count"), "lending_bank", "rpt_bank", "company").limit(limit)


def conflict_triangle(holds: DataFrame, lends: DataFrame, company_holds: DataFrame) -> DataFrame:
    """Owners of a bank that also own its borrower."""
    own = company_holds.select(F.col("lender").alias("owner"), "company")
    return holds.select("owner", "bank").join(own, "owner").join(lends.select("bank", "company"), ["bank", "company"]).select("owner", "bank", "company")


def industry_exposure(lends: DataFrame, industry: DataFrame) -> DataFrame:
    # each bank and company once, and each company and industry: companies are counted, and no set of them is kept
    loans = lends.groupBy("bank", "company").agg(F.sum("amount").alias("amount"))
    of = industry.groupBy("company", "industry").agg(F.count(F.lit(1)).alias("k"))
    return loans.join(of, "company").groupBy("bank", "industry").agg(F.round(F.sum(F.col("amount") * F.col("k")), 2).alias("exposure"), F.count(F.lit(1)).alias("num_companies"))


def top_industry(lends: DataFrame, industry: DataFrame, limit: int = 60) -> DataFrame:
    return industry_exposure(lends, industry).orderBy("bank", F.desc("exposure"), "industry").limit(limit)


def top_industries_per_bank(lends: DataFrame, industry: DataFrame, k: int = 5) -> DataFrame:
    """The first industry of each bank and its k largest as one string."""
    r = F.row_number().over(Window.partitionBy("bank").orderBy(F.desc("exposure"), "industry"))
    top = industry_exposure(lends, industry).withColumn("r", r).where(F.col("r") <= k)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "industry"))), lambda x: x["industry"]), ",")
    return top.groupBy("bank").agg(F.max(F.when(F.col("r") == 1, F.col("industry"))).alias("top_industry"), listed.alias("top_list"), F.round(F.sum("exposure"), 2).alias("top_exposure"))


def bank_bank_related(bank_rpt: DataFrame) -> DataFrame:
    return bank_rpt.select(F.col("a").alias("from_bank"), F.col("b").alias("to_bank"), F.col("parts").alias("txn_count"))


def related_and_borrower(lends: DataFrame, rpt: DataFrame) -> DataFrame:
    """Companies that are both related party and borrower, of the same bank or not."""
    other = rpt.select("company", F.col("bank").alias("rpt_with_bank"), F.col("up").alias("rpt_exposure"))
    return lends.join(other, "company").select("company", "rpt_with_bank", F.col("bank").alias("borrows_from_bank"), F.col("amount").alias("loan_amount"), "rpt_exposure", (F.col("bank") == F.col("rpt_with_bank")).alias("same_bank"))


def category_stakes(holds: DataFrame) -> DataFrame:
    return holds.groupBy("bank", "category").agg(F.round(F.sum("pct"), 4).alias("category_pct"), F.count_distinct("owner").alias("num_holders"))


def reach(holds: DataFrame, limit: int = 30) -> DataFrame:
    """Owners by the number of what they own."""
    found = holds.groupBy("owner").agg(F.count_distinct("bank").alias("total_holdings"), F.round(F.sum("pct"), 4).alias("total_stake_pct"))
    return found.orderBy(F.desc("total_holdings"), F.desc("total_stake_pct"), "owner").limit(limit)


def shared_subgraph(lends: DataFrame) -> DataFrame:
    """Edges to borrowers with several lenders."""
    shared = lends.groupBy("company").agg(F.count_distinct("bank").alias("k")).where("k > 1")
    return lends.join(shared, "company", "left_semi").select("bank", "company", "amount")


def company_ego(company: int, lends: DataFrame, rpt: DataFrame, holds: DataFrame) -> DataFrame:
    """All edges of one company."""
    parts = [
        lends.where(F.col("company") == company).select(F.lit("LENDS_TO").alias("type"), F.col("bank").alias("src"), F.col("company").alias("dst")),
        rpt.where(F.col("company") == company).select(F.lit("RELATED_PARTY").alias("type"), F.col("company").alias("src"), F.col("bank").alias("dst")),
        holds.where(F.col("owner") == company).select(F.lit("SHAREHOLDER_OF").alias("type"), F.col("owner").alias("src"), F.col("bank").alias("dst")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def degree_proxy(lends: DataFrame, rpt: DataFrame, holds: DataFrame, limit: int = 50) -> DataFrame:
    """Companies by the number of banks and of kinds of links to them."""
    kinds = [lends.select("company", "bank", F.lit("LENDS_TO").alias("type")), rpt.select("company", "bank", F.lit("RELATED_PARTY").alias("type")), holds.select(F.col("owner").alias("company"), "bank", F.lit("SHAREHOLDER_OF").alias("type"))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    found = every.groupBy("company").agg(F.count_distinct("bank").alias("bank_count"), F.count_distinct("type").alias("type_count"), joined(F.col("type")).alias("types"))
    return found.orderBy(F.desc("bank_count"), F.desc("type_count"), "company").limit(limit)


def chain2(lends: DataFrame, company_lends: DataFrame) -> DataFrame:
    """Bank to company to company."""
    return lends.select("bank", F.col("company").alias("lender")).join(company_lends, "lender").select("bank", F.col("lender").alias("company1"), F.col("company").alias("company2"))


def chain3(lends: DataFrame, company_lends: DataFrame) -> DataFrame:
    next_ = company_lends.select(F.col("lender").alias("company2"), F.col("company").alias("company3"))
    return chain2(lends, company_lends).join(next_, "company2").select("bank", "company1", "company2", "company3")


def bipartite_top(lends: DataFrame, limit: int = 200) -> DataFrame:
    return lends.select("bank", "company", "amount").orderBy(F.desc("amount"), "bank", "company").limit(limit)


def bank_ego(bank: int, lends: DataFrame) -> DataFrame:
    """What a bank reaches in one or two undirected steps: (kind, id, hops)."""
    first = lends.where(F.col("bank") == bank).select("company").distinct()
    second = lends.join(first, "company", "left_semi").select("bank").distinct().where(F.col("bank") != bank)
    return first.select(F.lit("company").alias("kind"), F.col("company").alias("id"), F.lit(1).alias("hops")).unionByName(second.select(F.lit("bank").alias("kind"), F.col("bank").alias("id"), F.lit(2).alias("hops")))


def bank_cluster(lends: DataFrame) -> DataFrame:
    """Pairs of banks two steps apart, and how many companies are between them."""
    return pair_sums(lends, "company", "bank")


def bank_company_industry(lends: DataFrame, industry: DataFrame) -> DataFrame:
    return lends.join(industry, "company").select("bank", "company", "industry", "amount")


def owner_bank_borrower(holds: DataFrame, lends: DataFrame) -> DataFrame:
    """Owners with a known stake of any size, their banks, and those banks' borrowers."""
    return holds.where(F.col("pct").isNotNull()).select("owner", "bank", "pct").join(lends.select("bank", "company"), "bank").select("owner", "bank", "company", "pct")


def circular(lends: DataFrame, holds: DataFrame) -> DataFrame:
    """Companies that borrow from a bank they own."""
    return lends.join(holds.select(F.col("owner").alias("company"), "bank", "pct"), ["company", "bank"]).select("company", "bank", "amount", "pct")


def related_lending_overlap(lends: DataFrame, rpt: DataFrame) -> DataFrame:
    return lends.select("bank", "company", "amount").join(rpt.select("bank", "company", "up"), ["bank", "company"]).select("bank", "company", F.col("amount").alias("loan_amount"), F.col("up").alias("rpt_exposure"))


def overview(banks: DataFrame, lends: DataFrame, rpt: DataFrame, holds: DataFrame) -> DataFrame:
    """Every bank and how many optional edges of each kind it has."""
    out = banks.select(F.col("s_suppkey").alias("bank"))
    for name, edges in (("borrowers", lends), ("related", rpt), ("holders", holds)):
        out = out.join(edges.groupBy("bank").agg(F.count(F.lit(1)).alias(name)), "bank", "left")
    return out.select("bank", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("borrowers", "related", "holders")])
