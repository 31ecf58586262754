"""Companies put together from their sources, and the older model of banks over years."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bank_key
from .kernels import _products, _standard, _weighted
from .quantiles import quantiles
from .shared import cut
from .stats import impute_median, winsorize, zscore


def consolidate(companies: DataFrame, bridge: DataFrame, registry: DataFrame, holdings: DataFrame) -> DataFrame:
    """companies (code, symbol, ...) with cin by the bridge (code, cin), all columns of the registry (cin, ...) and of the
    shareholdings (symbol, ...). Codes and symbols meet trimmed and in upper case; blank ones meet nothing. Where a source
    repeats a key its greatest row by all columns counts, so that no company comes twice."""
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))

    def one(df: DataFrame, key: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        rows = df.withColumn("_k", clean(F.col(key))).where("_k is not null").groupBy("_k").agg(F.max(F.struct(*rest)).alias("m"))
        return rows.select(F.col("_k").alias(name), *[f"m.{c}" for c in rest])

    out = companies.withColumn("_code", clean(F.col("code"))).join(one(bridge, "code", "_code"), "_code", "left").drop("_code")
    out = out.withColumn("_cin", clean(F.col("cin"))).join(one(registry, "cin", "_cin"), "_cin", "left").drop("_cin")
    return out.withColumn("_symbol", clean(F.col("symbol"))).join(one(holdings, "symbol", "_symbol"), "_symbol", "left").drop("_symbol")


def by_crosswalk(rows: DataFrame, name: str, crosswalk: DataFrame) -> DataFrame:
    """The rows with the symbol that a crosswalk (known, symbol) has for their name, both normalised as banks' names are;
    of a name that it has twice the least symbol counts."""
    known = crosswalk.groupBy(bank_key(F.col("known")).alias("_k")).agg(F.min("symbol").alias("symbol"))
    return rows.withColumn("_k", bank_key(F.col(name))).join(known, "_k", "left").drop("_k")


def in_all(key: str, *models: DataFrame) -> DataFrame:
    """The keys that all models have a row for."""
    out = models[0].select(key).where(F.col(key).isNotNull()).distinct()
    for m in models[1:]:
        out = out.join(m.select(key), key, "left_semi")
    return out


def counters(rows: DataFrame, label: str, value: str, flag: Column) -> DataFrame:
    """(label, n, least, most, mean, median, flagged) of each label, and of all rows under a null label."""
    labelled = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    both = labelled.select(F.lit(False).alias("_all"), F.col(label).alias("label"), value, "_flag").unionByName(labelled.select(F.lit(True).alias("_all"), F.lit(None).cast(dict(rows.dtypes)[label]).alias("label"), value, "_flag"))
    sums = both.groupBy("_all", "label").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count_if("_flag").alias("flagged"))
    mid = quantiles(both, ["_all", "label"], value, {"median": 0.5}).drop("n")
    on = F.col("s._all").eqNullSafe(F.col("m._all")) & F.col("s.label").eqNullSafe(F.col("m.label"))
    return sums.alias("s").join(mid.alias("m"), on, "left").select("s._all", F.col("s.label").alias(label), "s.n", "s.least", "s.most", "s.mean", "m.median", "s.flagged").withColumnRenamed("_all", "whole")


def panel_stress(panel: DataFrame, bank: str, year: str, metrics: dict[str, int], orient: str) -> DataFrame:
    """(bank, score) by the first principal component of banks' metrics over years, from 0 to 1.

    Missing values are the median of their year, values are cut to the 5th and 95th of 100 of their year and standardised
    within it, and turned by the metric's sign (1 where more of it is worse, -1 where less is). Of the last year each bank's
    values count, with the slope of each metric over its years, standardised over banks; 0 where a bank has one year only.
    The component points where `orient` grows. Banks without the last year have no score."""
    # written before the first metric and after each, since every quantile reads the rows several times
    rows = cut(panel.select(bank, year, *[F.col(m).cast("double").alias(m) for m in metrics]), "panel")
    for m, sign in metrics.items():
        rows = zscore(winsorize(impute_median(rows, year, m).drop(m).withColumnRenamed(f"{m}_imputed", m), year, m).drop(m).withColumnRenamed(f"{m}_cut", m), year, m)
        # a year in which all are the same has no deviation
        rows = cut(rows.drop(m).withColumn(m, sign * F.coalesce(f"{m}_z", F.lit(0.0))).drop(f"{m}_z"), "panel")
    last = rows.agg(F.max(year)).first()[0]
    trends = rows.groupBy(bank).agg(*[F.coalesce(F.regr_slope(m, year), F.lit(0.0)).alias(f"{m}_trend") for m in metrics])
    names = [*metrics, *[f"{m}_trend" for m in metrics]]
    now = cut(rows.where(F.col(year) == F.lit(last)).drop(year).join(trends, bank, "left").select(F.col(bank).alias("_id"), *names), "now")
    if last is None:
        return now.select(F.col("_id").alias(bank), F.lit(0.0).alias("score"))
    z = list(_standard(now, names).values())
    first = np.linalg.eigh(_products(now, z, z))[1][:, -1]
    first = first * (1 if first[names.index(orient)] >= 0 else -1)
    scored = now.select(F.col("_id").alias(bank), _weighted(z, first).alias("score"))
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    return scored.withColumn("score", (F.col("score") - low) / max(high - low, 1e-12))
