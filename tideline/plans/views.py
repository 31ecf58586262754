"""The credit network over the test tables, as DataFrames and, in the same terms, as SQL for an oracle.

Banks are suppliers, companies customers, facilities line items: a bank lends to a company what it supplied to it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import sql_round
from ..operators.graph_queries import met_pairs
from ..operators.shared import cut


class Tables:
    """The tables of a folder and the views on them; each is planned where it is used. With `kept`, the pairs of banks and
    companies are written once to the shared folder, for plans that read several views of them."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: bool = False):
        self.spark, self.sf_dir, self.kept = spark, sf_dir, kept

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        """Facilities: one per line item. Amounts are whole units, so that sums don't depend on their order; they are made
        before the join, which then shuffles them and not what they are made of."""
        amt = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) + 0.5).cast("double")
        gross = F.floor(F.col("l_extendedprice") + 0.5).cast("double")
        return (
            self["lineitem"]
            .select(F.col("l_suppkey").alias("bank"), amt.alias("amt"), gross.alias("gross"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_orderkey", "l_linenumber", "l_partkey")
            .join(self["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
            .select("bank", F.col("o_custkey").alias("company"), "amt", "gross", F.col("o_orderpriority").alias("priority"), "flag", "status", F.col("o_orderdate").alias("odate"), "l_orderkey", "l_linenumber", "l_partkey")
        )

    @cached_property
    def fac(self) -> DataFrame:
        """Facilities with their sector."""
        return self.items.join(self["part"].select("p_partkey", F.col("p_type").alias("facility")), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey", "l_partkey")

    @cached_property
    def pairs(self) -> DataFrame:
        """Every bank and company with facilities between them: sums of all, and of returned items."""
        back = F.col("flag") == "R"
        out = self.items.groupBy("bank", "company").agg(
            F.sum("amt").alias("amount"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(back, F.col("amt"))).alias("back"),
            F.sum(F.when(back & (F.col("status") == "O"), F.col("amt"))).alias("up"),
            F.count_if(back).alias("back_n"),
        )
        return cut(out, "pairs") if self.kept else out

    @cached_property
    def lends(self) -> DataFrame:
        """LENDS_TO edges. Sums of whole units need no rounding, which is slow: Spark rounds a double as a decimal."""
        return self.pairs.select("bank", "company", "amount", "n")

    @cached_property
    def rpt(self) -> DataFrame:
        """RELATED_PARTY edges from company to bank: returned items; `up` is what is still open."""
        return self.pairs.where("back_n > 0").select("company", "bank", F.col("back").alias("amount"), F.coalesce("up", F.lit(0.0)).alias("up"), F.col("back_n").alias("n"))

    @cached_property
    def holds(self) -> DataFrame:
        """SHAREHOLDER_OF edges from company to bank: companies of the bank's nation that deal with it, by their balances."""
        owners = self["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("company"), "c_nationkey", "c_acctbal", "c_mktsegment")
        banks = self["supplier"].select(F.col("s_suppkey").alias("bank"), "s_nationkey")
        own = self.pairs.select("bank", "company").join(owners, "company").join(banks, "bank").where("c_nationkey = s_nationkey")
        pct = 100 * F.col("c_acctbal") / F.sum("c_acctbal").over(Window.partitionBy("bank"))
        return own.select(F.col("company").alias("owner"), "bank", F.col("c_mktsegment").alias("category"), sql_round(pct, 4).alias("pct"))

    @cached_property
    def bank_holds(self) -> DataFrame:
        """SHAREHOLDER_OF edges between banks of one nation that share an order."""
        half = met_pairs(self["lineitem"], "l_orderkey", "l_suppkey").distinct()
        met = half.select(F.explode(F.array(F.struct(F.col("a").alias("owner"), F.col("b").alias("bank")), F.struct(F.col("b").alias("owner"), F.col("a").alias("bank")))).alias("m")).select("m.*")
        side = lambda c: self["supplier"].select(F.col("s_suppkey").alias(c), F.col("s_nationkey").alias(f"{c}_nation"), F.col("s_acctbal").alias(f"{c}_balance"))
        pairs = met.join(side("owner").where("owner_balance > 0"), "owner").join(side("bank"), "bank").where("owner_nation = bank_nation")
        pct = 100 * F.col("owner_balance") / F.sum("owner_balance").over(Window.partitionBy("bank"))
        return pairs.select("owner", "bank", sql_round(pct, 4).alias("pct"))

    @cached_property
    def co_lends(self) -> DataFrame:
        """Company to company: each to the next one, if that is of its segment."""
        next_ = self["customer"].select(F.col("c_custkey").alias("company"), (F.col("c_custkey") - 1).alias("lender"), F.col("c_mktsegment").alias("segment"))
        return self["customer"].select(F.col("c_custkey").alias("lender"), F.col("c_mktsegment").alias("segment")).join(next_, ["lender", "segment"]).select("lender", "company")

    @cached_property
    def bank_rpt(self) -> DataFrame:
        """Bank to bank: those that deal in the same parts."""
        return met_pairs(self["lineitem"], "l_partkey", "l_suppkey").groupBy("a", "b").agg(F.count(F.lit(1)).alias("parts"))

    @cached_property
    def industry(self) -> DataFrame:
        """BELONGS_TO edges."""
        return self["customer"].select(F.col("c_custkey").alias("company"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), F.col("c_nationkey").alias("nation"))


VIEWS_SQL = {
    "fac": """SELECT l_suppkey AS bank, o_custkey AS company, p_type AS facility, floor(l_extendedprice * (1 - l_discount) + 0.5) AS amt, floor(l_extendedprice + 0.5) AS gross,
  o_orderpriority AS priority, l_returnflag AS flag, l_linestatus AS status, o_orderdate AS odate, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "lends": "SELECT bank, company, round(sum(amt), 2) AS amount, count(*) AS n FROM fac GROUP BY bank, company",
    "rpt": """SELECT company, bank, round(sum(amt), 2) AS amount, round(coalesce(sum(amt) FILTER (WHERE status = 'O'), 0.0), 2) AS up, count(*) AS n
  FROM fac WHERE flag = 'R' GROUP BY company, bank""",
    "holds": """SELECT company AS owner, bank, c_mktsegment AS category, round(100 * c_acctbal / sum(c_acctbal) OVER (PARTITION BY bank), 4) AS pct
  FROM lends JOIN customer ON c_custkey = company JOIN supplier ON s_suppkey = bank WHERE c_acctbal > 0 AND c_nationkey = s_nationkey""",
    "bank_holds": """SELECT a.s_suppkey AS owner, b.s_suppkey AS bank, round(100 * a.s_acctbal / sum(a.s_acctbal) OVER (PARTITION BY b.s_suppkey), 4) AS pct
  FROM (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey)
  JOIN supplier a ON a.s_suppkey = a JOIN supplier b ON b.s_suppkey = b AND a.s_nationkey = b.s_nationkey WHERE a.s_acctbal > 0""",
    "co_lends": """SELECT x.c_custkey AS lender, y.c_custkey AS company FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND x.c_mktsegment = y.c_mktsegment""",
    "bank_rpt": """SELECT x.s AS a, y.s AS b, count(*) AS parts FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) x
   JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) y ON x.p = y.p AND x.s < y.s GROUP BY ALL""",
    "industry": "SELECT c_custkey AS company, c_name AS name, c_mktsegment AS industry, c_nationkey AS nation FROM customer",
}
_NEEDS = {"lends": ["fac"], "rpt": ["fac"], "holds": ["fac", "lends"]}


def sql(body: str, *views: str) -> str:
    """A query with the views it names, and those they need, in front."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*_NEEDS.get(v, []), v) if x not in names]
    head = ",\n".join(f"{v} AS ({VIEWS_SQL[v]})" for v in names)
    recursive = body.lstrip().startswith("RECURSIVE")
    body = body.lstrip().removeprefix("RECURSIVE").lstrip()
    if not head:
        return f"WITH RECURSIVE {body}" if recursive else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (",\n" + body[1:] if body.startswith(",") else f"\n{body}")
