"""Tests of names and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import company_key

# Words of company names.
CORPORATE_WORDS = (
    "ltd", "limited", "pvt", "private", "corp", "corporation", "inc",
    "bank", "finance", "insurance", "capital", "technologies", "technology",
    "investments", "ventures", "securities", "asset", "management",
    "services", "solutions", "industries", "enterprises", "holdings",
    "infrastructure", "energy", "power", "motors", "chemicals",
    "pharmaceuticals", "developers", "properties", "realty", "foundation",
    "llp",
)
# What stands for no lender.
NO_LENDER = ("", "not applicable", "na", "n/a", "nil", "none", "not available", "tbd", "to be decided", "-")


def is_ticker(x: Column) -> Column:
    """2 to 15 capital letters."""
    return F.coalesce(x.rlike(r"\A[A-Z]{2,15}\z"), F.lit(False))


def is_corporate(name: Column) -> Column:
    """Whether a name has a word of company names in it, anywhere."""
    return F.coalesce(F.lower(name).rlike("|".join(CORPORATE_WORDS)), F.lit(False))


def is_subsidiary(relation: Column) -> Column:
    return F.coalesce(F.lower(relation).rlike("subsidiar|associate"), F.lit(False))


def is_lender(name: Column) -> Column:
    raw = F.coalesce(F.trim(name), F.lit(""))
    # company_key makes a space of a slash and of a dash
    return ~F.lower(raw).isin(*NO_LENDER) & ~company_key(raw).isin(*NO_LENDER, "n a")


def is_summary(label: Column, headings: tuple[str, ...] = ()) -> Column:
    """Rows of totals, averages and medians, and headings that are given."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = low.rlike("total|average|median")
    return out | low.isin(*headings) if headings else out


def allowed(rows: DataFrame, name: str, names: DataFrame, known: str) -> DataFrame:
    """Rows whose name is on a list, both normalised."""
    return rows.join(names.select(company_key(F.col(known)).alias("_k")), company_key(F.col(name)) == F.col("_k"), "left_semi")


def year_in(x: Column) -> Column:
    """The first year from 2020 to 2029 in a text, else its last four digits at the end; null without either."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"202\d", 0), F.lit("")), F.nullif(F.regexp_extract(x, r"(\d{4})\s*$", 1), F.lit(""))).cast("int")


def camel(x: Column) -> Column:
    """A name in Pascal case with its first letter in lower case."""
    return F.concat(F.lower(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))
