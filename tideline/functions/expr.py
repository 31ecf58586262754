"""Column helpers: safe casts, cleaning of numbers, dates and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats, tried in turn.
DATE_FORMATS = ("MMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
#: Legal forms that names are compared without.
LEGAL_WORDS = ("ltd", "limited", "pvt", "private", "inc", "incorporated", "corp", "corporation", "co", "company", "llp", "llc", "plc", "ag", "sa", "nv", "bv")


def number(x: Column) -> Column:
    """A number from text with thousands separators; dashes, NA and blanks are null."""
    text = F.trim(x.cast("string"))
    return F.regexp_replace(F.when(~F.upper(text).isin("", "-", "NA", "N/A"), text), ",", "").try_cast("double")


def percent(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "%$", "").try_cast("double")


def flag(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def date(x: Column) -> Column:
    """A date in the first of DATE_FORMATS that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)).cast("date") for f in DATE_FORMATS])


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))  # either one skips nulls


def at_most(x: Column, most: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(most)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once even if body uses it often or within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_round(x: Column, places: int) -> Column:
    """A double rounded as DuckDB's round() does: the scaled double, halves away from zero. Spark's own rounds the shortest
    decimal, so that 3.25215E-5, whose scaled double is below the half, comes out one apart at nine places."""
    return F.round(x * float(10**places)) / float(10**places)


def valid_weight(w: Column) -> Column:
    """A transmission weight: finite and above 0, at most 1; else null."""
    return F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), F.least(w, F.lit(1.0)))


def slug(x: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def company_key(x: Column) -> Column:
    """A name for comparison: lower case, no punctuation, no legal form."""
    plain = F.regexp_replace(F.lower(x), r"[&\-–,.()/\\]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(LEGAL_WORDS)})\b\.?", " "), r"\s+", " "))


def bank_key(x: Column) -> Column:
    out = F.regexp_replace(F.upper(F.trim(x)), "&", " AND ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(LIMITED|LTD)\b\.?", " "), r"\s+", " "))


#: Letters that are written in ASCII; any other letter beyond it goes.
ASCII_FORMS = {"–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "₹": "Rs.", " ": " "}


def ascii_text(x: Column) -> Column:
    shown = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ASCII_FORMS.items(), x)
    return F.trim(F.regexp_replace(shown, r"[^\x00-\x7F]", ""))


def chain(value: Column, cases: list[tuple[Column, object]], other=None) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda out, c: F.when(c[0], F.lit(c[1])).otherwise(out), reversed(cases), F.lit(other) if not isinstance(other, Column) else other)


def lookup(key: Column, table: dict) -> Column:
    """A constant table as a literal map; null where a key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
