"""Standard names of bank metrics, as sheets spell them in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let, lookup

# A name that holds all words of a rule is its metric; the first rule that fits counts.
HOLDS = [
    (("business per employee",), "Business Per Employee"),
    (("profit per employee",), "Profit Per Employee"),
    (("capital adequacy ratio",), "Capital Adequacy Ratio (Basel-III)"),
    (("car",), "Capital Adequacy Ratio (Basel-III)"),
    (("operating", "exp", "%"), "Operating Expenses as % to Total Expenses"),
    (("provision", "contingenc"), "Provisions & Contingencies"),
    (("provision", "coverage"), "Provision Coverage Ratio (%)"),
    (("return on assets",), "Return on Assets (%)"),
    (("spread", "asset"), "Spread as % of Total Assets"),
    (("net npa as %",), "Net NPA as % to Net Advances"),
    (("total expenditure",), "Total Expenditure"),
]
# Names that are metrics as they stand.
EQUALS = ["Gross NPA", "Net NPA", "Operating Profit", "Net Profit", "Operating Expenses", "Interest Expended", "Interest Income", "Other Income", "Total Income", "Total Assets", "Credit Deposit Ratio", "Investment Deposit Ratio", "Investments", "Advances", "Deposits"]


def metric_name(raw: Column) -> Column:
    """The standard name, else the name with capitals; null stays null."""

    def named(clean: Column) -> Column:
        cases = []
        for words, name in HOLDS:
            fits = F.lit(True)
            for w in words:
                fits = fits & clean.contains(w)
            cases.append(F.when(fits, F.lit(name)))
        return F.coalesce(*cases, lookup(clean, {n.lower(): n for n in EQUALS}), F.initcap(F.trim(raw)))

    return let(F.lower(F.trim(F.regexp_replace(raw, r"[*#\s]+", " "))), named)
