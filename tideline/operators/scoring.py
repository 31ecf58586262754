"""Scores of sectors, companies and banks: blends, bands, and health of supervisory ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import chain, clamp

# From and to of the three market norms.
RETURN_NORM, VOLATILITY_NORM, DRAWDOWN_NORM = (0.10, -0.25), (0.08, 0.45), (0.0, 0.35)
# Upper ends of the risk tiers.
TIERS = ((0.20, "Minimal"), (0.40, "Low"), (0.55, "Moderate"), (0.70, "Elevated"), (0.85, "High"))
TOP_TIER = "Severe"
# Supervisory triggers: first trigger and optimum.
TRIGGERS = {"totalCAR": (11.5, 16.0), "tier1CAR": (9.5, 14.0), "tier1Leverage": (3.5, 6.0)}
# Floor and optimum of ratios that should be high.
HIGHER = {"returnOnAssets": (0.0, 1.5), "returnOnEquity": (0.0, 18.0), "operatingProfitsToTotalAssets": (0.0, 2.5), "netInterestMargin": (1.5, 3.5), "returnOnAdvances": (4.0, 9.0), "returnOnInvestments": (4.0, 8.0), "interestIncomeToTotalAssets": (4.0, 8.0), "nonInterestIncomeToTotalAssets": (0.0, 1.5), "cashDepositRatio": (3.0, 6.0)}
# Ceiling and optimum of ratios that should be low.
LOWER = {"investmentDepositRatio": (45.0, 27.0), "burdenToTotalAssets": (2.5, 0.5), "intermediationCostToTotalAssets": (3.5, 1.5), "wageBillsToTotalExpense": (55.0, 35.0), "costOfFunds": (7.5, 4.0), "costOfDeposits": (7.0, 3.5)}
# Floor, optimum and ceiling of a ratio with a best range.
RANGE = {"creditDepositRatio": (55.0, 72.0, 85.0)}
# Dimensions, their weights and ratios.
CAMELS = {"Capital": (0.25, ("totalCAR", "tier1CAR")), "AssetQuality": (0.30, ("netNPAToNetAdvances",)), "Management": (0.10, ("wageBillsToTotalExpense", "intermediationCostToTotalAssets")), "Earnings": (0.20, ("returnOnAssets", "returnOnEquity", "netInterestMargin", "operatingProfitsToTotalAssets")), "Liquidity": (0.10, ("cashDepositRatio", "creditDepositRatio", "investmentDepositRatio")), "Sensitivity": (0.05, ("costOfFunds", "burdenToTotalAssets"))}


def _norm(x: Column, ends: tuple[float, float]) -> Column:
    """0 at the first end, 1 at the second."""
    return clamp((x - ends[0]) / (ends[1] - ends[0]))


def market_stress(ret: Column, vol: Column, drawdown: Column) -> Column:
    return (_norm(ret, RETURN_NORM) + _norm(vol, VOLATILITY_NORM) + _norm(drawdown, DRAWDOWN_NORM)) / 3


def sector_blend(news: Column, market: Column) -> Column:
    """Half of each, or the news alone."""
    return F.round(F.coalesce((news + market) / 2, news), 4)


def risk_tier(score: Column) -> Column:
    return F.when(score.isNotNull(), chain(score, [(score < hi, name) for hi, name in TIERS], TOP_TIER))


def company_blend(fundamental: Column, news: Column, sector: Column) -> Column:
    """Ratings (0 to 100) with news and sector, 0.7, 0.2, 0.1; without one of them 0.8 and 0.2; alone in full. Null
    without ratings."""
    f = fundamental / 100
    return F.when(news.isNotNull() & sector.isNotNull(), 0.7 * f + 0.2 * news + 0.1 * sector).when(news.isNotNull(), 0.8 * f + 0.2 * news).when(sector.isNotNull(), 0.8 * f + 0.2 * sector).otherwise(f)


def bank_blend(boundary: Column, merton: Column, camels: Column, news: Column, stored: Column) -> Column:
    """All four at 0.23, 0.23, 0.27, 0.27; else the stored score with news at 0.73, 0.27; else the stored score."""
    return F.coalesce(0.23 * boundary + 0.23 * merton + 0.27 * camels + 0.27 * news, 0.73 * stored + 0.27 * news, stored)


def health(ratio: str, x: Column) -> Column:
    """Health of a ratio from 0 to 1; 0.5 where it is null or has no threshold."""
    def sigmoid(center: float, scale: float) -> Column:
        return 1 / (1 + F.exp((x - center) / scale))

    if ratio == "netNPAToNetAdvances":
        cases = [(x <= 0.5, F.lit(1.0)), (x <= 6, 1 - 0.30 * (x - 0.5) / 5.5), (x <= 9, 0.70 - 0.35 * (x - 6) / 3), (x <= 12, 0.35 - 0.25 * (x - 9) / 3)]
        out = F.greatest(F.lit(0.0), 0.10 - (x - 12) * 0.01)
        for test, value in reversed(cases):
            out = F.when(test, value).otherwise(out)
    elif ratio in TRIGGERS:
        at, best = TRIGGERS[ratio]
        out = 1 - sigmoid(at, max((best - at) / 4, 0.3))
    elif ratio in HIGHER:
        at, best = HIGHER[ratio]
        out = 1 - sigmoid(at, max((best - at) / 4, 0.2))
    elif ratio in LOWER:
        at, best = LOWER[ratio]
        out = sigmoid(at, max((at - best) / 4, 0.3))
    elif ratio in RANGE:
        lo, best, hi = RANGE[ratio]
        out = F.exp(-((x - best) * (x - best)) / (2 * ((hi - lo) / 4) ** 2))
    else:
        return F.lit(0.5)
    return F.coalesce(out, F.lit(0.5))


def camels(df: DataFrame, ratios: dict[str, str]) -> DataFrame:
    """Adds the stress of each dimension (the mean of 1 - health over its ratios that have a column) and camels, their
    weighted mean. ratios: ratio -> column."""
    total, weight = F.lit(0.0), 0.0
    for name, (w, fields) in CAMELS.items():
        known = [1 - health(f, F.col(ratios[f])) for f in fields if f in ratios]
        if known:
            df = df.withColumn(name, sum(known[1:], known[0]) / len(known))
            total, weight = total + w * F.col(name), weight + w
    return df.withColumn("camels", total / weight)


def final_blend(boundary: Column, merton: Column, camels_: Column) -> Column:
    return clamp(0.40 * boundary + 0.35 * merton + 0.25 * camels_)


def debt_proxy(deposits: Column, borrowings: Column, liabilities: Column, equity: Column) -> Column:
    """Deposits and half the borrowings, else nine tenths of liabilities, else ten times equity."""
    return F.coalesce(deposits + 0.5 * borrowings, 0.9 * liabilities, 10 * equity)


def herfindahl(amounts: DataFrame, by: str, value: str) -> DataFrame:
    return amounts.groupBy(by).agg(F.try_divide(F.sum(F.col(value) * F.col(value)), F.sum(value) * F.sum(value)).alias("hhi"))


def news_score(negative: Column, neutral: Column) -> Column:
    return negative + 0.5 * neutral


def confidence(articles: Column) -> Column:
    return F.when(articles >= 5, "high").when(articles >= 2, "medium").otherwise("low")


def news_band(score: Column) -> Column:
    """The band of a news score."""
    return F.when(score >= 0.8, "Severe").when(score >= 0.6, "High").when(score >= 0.4, "Moderate").when(score >= 0.2, "Low").otherwise("Minimal")
