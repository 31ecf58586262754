"""Stress of a company from its credit ratings: two models over arrays of rated items, without exploding them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import at_most, chain, clamp, let, lookup

# Default probabilities of long-term grades.
LT_PD = {"AAA": 0.0, "AA+": 0.0003, "AA": 0.0005, "AA-": 0.0008, "A+": 0.0006, "A": 0.0007, "A-": 0.0012, "BBB+": 0.0025, "BBB": 0.0046, "BBB-": 0.011, "BB+": 0.019, "BB": 0.0286, "BB-": 0.046, "B+": 0.061, "B": 0.084, "B-": 0.12, "C": 0.2498, "D": 1.0}
# Default probabilities of short-term grades.
ST_PD = {"A1+": 0.0002, "A1": 0.0001, "A2+": 0.001, "A2": 0.0023, "A2-": 0.003, "A3+": 0.003, "A3": 0.0043, "A3-": 0.0055, "A4+": 0.03, "A4": 0.0472, "A4-": 0.06}
# Probabilities of a downgrade.
LT_DOWN = {"AAA": 0.0, "AA+": 0.005, "AA": 0.0175, "AA-": 0.02, "A+": 0.025, "A": 0.0304, "A-": 0.038, "BBB+": 0.042, "BBB": 0.0464, "BBB-": 0.055, "BB+": 0.06, "BB": 0.0657, "BB-": 0.075, "B+": 0.082, "B": 0.088, "B-": 0.12, "C": 0.4677, "D": 1.0}
# Multipliers of outlooks, tried in this order.
OUTLOOK = {"positive": 0.8, "watch positive": 0.75, "improving": 0.8, "stable": 1.0, "developing": 1.15, "under watch": 1.2, "credit watch": 1.25, "rating watch": 1.25, "negative": 1.3, "watch negative": 1.5, "creditwatch neg": 1.5}
# Weights of the nine components.
WEIGHTS = {"c1": 0.25, "c2": 0.2, "c3": 0.15, "c4": 0.1, "c5": 0.1, "c6": 0.1, "c7": 0.05, "c8": 0.03, "c9": 0.02}
# Headings among the instruments, which are no ratings.
HEADINGS = ("RATING OUTSTANDINGWITH OUTLOOK", "RATING OUTSTANDING WITH OUTLOOK", "RATING OUTSTANDING", "RATING", "ISIN", "NAME OF INSTRUMENT", "DATE OFALLOTMENT", "COUPONRATE (%)", "MATURITYDATE", "COMPLEXITYLEVELS")
# The second model's stress of grades.
LT_STRESS = {"AAA": 0.0, "AA+": 0.00025, "AA": 0.0005, "AA-": 0.00057, "A+": 0.00063, "A": 0.0007, "A-": 0.002, "BBB+": 0.0033, "BBB": 0.0046, "BBB-": 0.0126, "BB+": 0.0206, "BB": 0.0286, "BB-": 0.04707, "B+": 0.06553, "B": 0.084, "B-": 0.1669, "C": 0.2498, "D": 1.0}
ST_STRESS = {"A1+": 0.0, "A1": 0.0005, "A2+": 0.00063, "A2": 0.002, "A3+": 0.0046, "A3": 0.0126, "A4+": 0.0286, "A4": 0.084}
# Unrated companies lie in a band from here, this wide; with no component at all, the score.
UNRATED_FROM, UNRATED_WIDTH, NO_COMPONENT = 40.0, 30.0, 0.3
UNCOOPERATIVE = 1.5
STALE_FROM, STALE_TO = 365, 730
LT_GRADE = {g: k + 1 for k, g in enumerate(LT_PD)}
_PD = LT_PD | ST_PD


def clean_rating(raw: Column) -> Column:
    """The grade of a rating text without agency and outlook; null gives an empty one."""
    r = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^(CRISIL|Crisil|crisil) ", "")
    r = F.regexp_replace(F.lower(r), r"/stable|/positive|/negative|/watch|/developing|\(stable\)|\(positive\)|\(negative\)", "")
    return F.trim(F.regexp_replace(F.trim(F.upper(r)), "&+$", ""))


def resolve(raw: Column) -> Column:
    """struct(token, mult) of a rating text: an uncooperative or withdrawn issuer's last grade counts for more, and a
    bare withdrawal has no token."""
    first = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^(CRISIL|Crisil|crisil) ", "")
    base = F.trim(F.regexp_replace(F.upper(F.trim(F.split(first, "/")[0])), r"\*+$", ""))
    silent = F.coalesce(raw, F.lit("")).rlike(r"(?i)issuer\s*not\s*co.?operating|withdrawn")
    known = base.isin(*_PD)
    token = F.when(silent, F.when(known, base).otherwise("")).otherwise(clean_rating(raw))
    return F.struct(token.alias("token"), F.when(silent & known, F.lit(UNCOOPERATIVE)).otherwise(F.lit(1.0)).alias("mult"))


def outlook_multiplier(raw: Column) -> Column:
    """Of the first outlook that the text contains, in the table's order; stable where there is none."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return chain(text, [(text.contains(k), v) for k, v in OUTLOOK.items()], 1.0)


def _rated(items: Column, rating: str, amount: str | None) -> Column:
    """What is known of each item: token, pd, amount above 0, and whether it is long-term."""

    def one(x: Column) -> Column:
        r = resolve(x[rating])
        pd = at_most(lookup(r["token"], _PD) * r["mult"])
        a = x[amount].try_cast("double") if amount else F.lit(None).cast("double")
        return F.struct(r["token"].alias("token"), pd.alias("pd"), F.when(a > 0, a).alias("amount"), r["token"].isin(*LT_PD).alias("lt"))

    return F.transform(F.coalesce(items, F.array()), one)


def score(components: dict[str, Column]) -> Column:
    """Mean of the components that are not null, by their weights."""
    weight = sum((F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in components.items()), F.lit(0.0))
    total = sum((F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in components.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(F.lit(NO_COMPONENT))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def entity_stress(companies: DataFrame, as_of: Column) -> DataFrame:
    """Adds stress (0 to 100), label, tier and the components c1 to c9 to companies with crisil_ratings
    (rating, outlook), facilities (rating, amount), instruments (rating, issue_size) and rating_date.

    Null arrays are empty. as_of stands for today, so that results repeat. An item without a known grade counts as
    unrated; of the ratings themselves the first long-term and the first short-term one count.
    """
    pool = companies.withColumn("_r", F.filter(F.transform(F.coalesce("crisil_ratings", F.array()), lambda x: F.struct(resolve(x["rating"]).alias("k"), x["outlook"].alias("outlook"))), lambda x: x["k"]["token"] != ""))

    def first_of(table: dict) -> Column:
        return F.get(F.filter("_r", lambda x: x["k"]["token"].isin(*table)), F.lit(0))

    pool = pool.withColumn("_lt", first_of(LT_PD)).withColumn("_st", first_of(ST_PD))
    pd_of = lambda c: at_most(lookup(F.col(f"{c}.k.token"), _PD) * F.col(f"{c}.k.mult"))
    inst = F.filter(F.coalesce("instruments", F.array()), lambda x: (clean_rating(x["rating"]) != "") & ~clean_rating(x["rating"]).isin(*HEADINGS))
    pool = pool.withColumn("_items", F.concat(_rated(F.col("facilities"), "rating", "amount"), _rated(inst, "rating", "issue_size")))
    pool = pool.withColumn("_known", F.filter("_items", lambda x: x["pd"].isNotNull())).withColumn("_paid", F.filter("_known", lambda x: x["amount"].isNotNull()))
    pool = pool.withColumn("_lt_pd", pd_of("_lt")).withColumn("_st_pd", pd_of("_st"))
    pool = pool.withColumn("exposure", _sum(F.col("_paid.amount"))).withColumn("_pds", F.concat(F.col("_known.pd"), F.array_compact(F.array("_lt_pd", "_st_pd"))))
    n, total = F.size("_pds"), F.size("_items") + F.size(F.coalesce("crisil_ratings", F.array()))
    ew = F.when(F.col("exposure") > 0, _sum(F.transform("_paid", lambda x: x["pd"] * x["amount"])) / F.col("exposure"))
    mult = F.when(F.col("_lt").isNotNull(), outlook_multiplier(F.col("_lt.outlook"))).otherwise(1.0)
    mean = _sum(F.col("_pds")) / n
    spread = F.sqrt(_sum(F.transform("_pds", lambda x: (x - mean) * (x - mean))) / (n - 1))
    pool = pool.withColumn("_ew", at_most(ew * mult))
    primary = F.coalesce(at_most(F.col("_lt_pd") * mult), "_ew", "_st_pd")
    log_pd = lambda p: F.log(1 + 99 * clamp(p)) / math.log(100)
    age = F.datediff(as_of, F.col("rating_date"))
    c = {
        "c1": F.when(primary.isNotNull(), log_pd(primary)),
        "c2": F.when(F.col("_ew").isNotNull(), log_pd(F.col("_ew"))),
        "c3": at_most(lookup(F.col("_lt.k.token"), LT_DOWN) / 0.25),
        "c4": F.when(n > 1, F.least(spread / 0.5, F.lit(1.0))),
        "c5": F.when(F.col("exposure") > 0, F.least(F.log10(1 + F.col("exposure")) / 4, F.lit(1.0))),
        "c6": F.when(total > 0, 1 - n / total),
        "c7": F.when(age <= STALE_FROM, 0.0).when(age.isNotNull(), F.least((age - STALE_FROM) / (STALE_TO - STALE_FROM), F.lit(1.0))),
        "c8": F.when(F.col("exposure") > 0, _sum(F.transform("_paid", lambda x: x["amount"] * x["amount"])) / (F.col("exposure") * F.col("exposure"))),
        "c9": F.when(F.col("_lt").isNotNull(), 0.0).when(F.col("_st").isNotNull(), 1.0),
    }
    for k, v in c.items():
        pool = pool.withColumn(k, v)
    c = {k: F.col(k) for k in c}
    rated = primary.isNotNull()
    stress = F.when(rated, F.round(score(c) * 100, 2)).otherwise(F.round(UNRATED_FROM + UNRATED_WIDTH * score({k: c[k] for k in ("c5", "c6", "c7", "c8")}), 2))
    out = pool.withColumn("stress", stress).withColumn("label", stress_label(F.col("stress"))).withColumn("tier", rating_tier(F.coalesce(F.col("_lt.k.token"), F.col("_st.k.token"))))
    told = lambda test: F.array_join(F.array(*[F.when(test(v), F.lit(k)) for k, v in c.items()]), ",")
    return out.withColumn("active", told(Column.isNotNull)).withColumn("skipped", told(Column.isNull)).drop("_r", "_lt", "_st", "_items", "_known", "_paid", "_lt_pd", "_st_pd", "_pds", "_ew")


def stress_label(s: Column) -> Column:
    return chain(s, [(s < 5, "Minimal"), (s < 15, "Low"), (s < 30, "Moderate"), (s < 50, "Elevated"), (s < 70, "High")], "Severe")


def rating_tier(token: Column) -> Column:
    t = F.upper(F.coalesce(token, F.lit("")))
    high = [g for g in LT_PD if LT_GRADE[g] <= LT_GRADE["BBB-"]] + ["A1+", "A1", "A2+", "A2", "A2-"]
    low = [g for g in _PD if g not in high and g not in ("C", "D")]
    return chain(t, [(t.isin(*high), "Investment Grade"), (t.isin(*low), "Sub-Investment Grade"), (t == "C", "Near Default"), (t == "D", "Default")], "Unrated")


def anchored_stress(raw: Column) -> Column:
    """Stress of one rating text in the second model; null where it has no grade."""
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "(?i)^crisil ", "")
    low = F.lower(s)
    mult = F.when(low.contains("issuer not cooperating"), 3.0).otherwise(1.0) * F.when(low.contains("watch negative"), 1.5).when(low.contains("watch positive"), 0.8).otherwise(1.0)
    return at_most(lookup(F.upper(F.split(s, r"[/\s]")[0]), ST_STRESS | LT_STRESS) * mult)


def weighted_median(facilities: Column) -> Column:
    """struct of score, basis, scored, skipped, total, dominant for facilities (rating, amount): the stress at which,
    from the largest amount down, half of all is reached; without amounts the plain median. Null where none is rated.
    Of equal amounts the first in the array comes first."""

    def row(x: Column, i: Column) -> Column:
        return F.struct((-F.coalesce(x["amount"].try_cast("double"), F.lit(0.0))).alias("less"), i.alias("i"), anchored_stress(x["rating"]).alias("s"), x["rating"].alias("rating"))

    def of(all_: Column) -> Column:
        n = F.size(all_)
        some = F.array_sort(F.filter(all_, lambda x: x["s"].isNotNull()))
        return let(some, lambda scored: let(-_sum(F.transform(scored, lambda x: x["less"])), lambda total: median(n, scored, total)))

    def median(n: Column, scored: Column, total: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("string").alias("rating"))

        def step(acc: Column, x: Column) -> Column:
            sum_ = acc["sum"] - F.try_divide(x["less"], total)
            here = acc["s"].isNull() & (sum_ >= 0.5)
            return F.struct(sum_.alias("sum"), F.when(here, x["s"]).otherwise(acc["s"]).alias("s"), F.when(here, x["rating"]).otherwise(acc["rating"]).alias("rating"))

        last, by, k = F.get(scored, F.size(scored) - 1), total > 0, F.size(scored)
        plain = F.array_sort(F.transform(scored, lambda x: x["s"]))
        mid = (F.get(plain, F.floor((k - 1) / 2).cast("int")) + F.get(plain, F.floor(k / 2).cast("int"))) / 2

        def out(found: Column) -> Column:
            return F.struct(
                F.round(F.when(by, F.coalesce(found["s"], last["s"])).otherwise(mid), 6).alias("score"),
                F.when(by, "weighted_median").otherwise("unweighted_median").alias("basis"),
                k.alias("scored"),
                (n - k).alias("skipped"),
                F.round(total, 4).alias("total"),
                F.when(by, F.coalesce(found["rating"], last["rating"])).otherwise("").alias("dominant"),
            )

        return F.when(k > 0, let(F.aggregate(scored, start, step), out))

    return let(F.transform(F.coalesce(facilities, F.array()), row), of)
