"""Numeric models of banks: Merton's two equations, kernel principal components, ridge, and principal components.

Merton's model is solved for many rows of a batch at once. Principal components and ridge come from sums over all rows
and score rows by column expressions. Kernel components are fitted on at most MAX_ROWS rows, those with the least hashes
of the id, and every row is projected on them in tasks; up to MAX_ROWS rows the fit is over all.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Horizon in years, riskless rate, components, kernel width, ridge penalty.
HORIZON, RATE, COMPONENTS, GAMMA, ALPHA = 0.25, 0.065, 10, 0.0681292, 1.0
# Fixed value: what both equations may miss, as a share of the equity.
RESIDUAL = 0.01
MAX_ROWS = 5000
_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def solve_merton(equity: np.ndarray, vol: np.ndarray, debt: np.ndarray, t: float = HORIZON, r: float = RATE, steps: int = 60, newton: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Asset value, asset volatility and whether they solve both equations, with equity as a call on assets.

    All rows go through a damped fixed point, then Newton's steps that lessen what is left. Rows for which that stays at
    RESIDUAL of the equity or more get the closed form: equity and discounted debt, with equity's share of volatility."""
    root, owed = math.sqrt(t), debt * math.exp(-r * t)

    def gaps(v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        d1 = (np.log(v / debt) + (r + s * s / 2) * t) / (s * root)
        d2 = d1 - s * root
        n1 = normal_cdf(d1)
        return v * n1 - owed * normal_cdf(d2) - equity, n1 * s * v - vol * equity, d1, d2, n1

    with np.errstate(all="ignore"):
        v, s = equity + debt, vol * equity / (equity + debt)
        for _ in range(steps):
            _, _, _, d2, n1 = gaps(v, s)
            v = 0.5 * v + 0.5 * (equity + owed * normal_cdf(d2)) / np.maximum(n1, 1e-9)
            s = 0.5 * s + 0.5 * vol * equity / (v * np.maximum(n1, 1e-9))
        for _ in range(newton):
            f, g, d1, d2, n1 = gaps(v, s)
            density = np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
            fv, fs, gv, gs = n1, v * density * root, density / root + n1 * s, v * (n1 - density * d2)
            whole = fv * gs - fs * gv
            nv, ns = v - (f * gs - g * fs) / whole, s - (g * fv - f * gv) / whole
            nf, ng, *_ = gaps(np.where(nv > 0, nv, v), np.where(ns > 0, ns, s))
            better = (nv > 0) & (ns > 0) & (np.abs(nf) + np.abs(ng) < np.abs(f) + np.abs(g))
            v, s = np.where(better, nv, v), np.where(better, ns, s)
        f, g, *_ = gaps(v, s)
        solved = np.abs(f) + np.abs(g) < RESIDUAL * equity
    plain = equity + owed
    return np.where(solved, v, plain), np.where(solved, s, vol * equity / plain), solved


def merton(equity: Column, vol: Column, debt: Column) -> Column:
    """struct(asset_value, asset_vol, dtd, default_probability, converged); null where an input is null or not above 0."""
    names = ["asset_value", "asset_vol", "dtd", "default_probability", "converged"]

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for e, s, d in batches:
            x = np.array([e, s, d], float)
            ok = (np.isfinite(x) & (x > 0)).all(0)
            out = np.full((5, x.shape[1]), np.nan)
            if ok.any():
                v, a, solved = solve_merton(*x[:, ok])
                dtd = (np.log(v / x[2, ok]) + (RATE - a * a / 2) * HORIZON) / (a * math.sqrt(HORIZON))
                out[:, ok] = v, a, dtd, normal_cdf(-dtd), solved
            frame = pd.DataFrame(dict(zip(names, out, strict=True))).astype(object).where(lambda f: f.notna(), None)
            frame["converged"] = [None if c is None else bool(c) for c in frame["converged"]]
            yield frame

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names[:4]) + ", converged boolean")(equity, vol, debt)


def _known(c: str, other: Column | None = None) -> Column:
    """A number that is neither null nor NaN, or else `other`."""
    x = F.col(c).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(None).cast("double") if other is None else other)


def _standard(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Standardised columns of a frame without nulls, by means and deviations of all rows."""
    m = df.agg(*[f(c).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (F.col(c) - F.lit(m[f"m_{k}"])) / F.lit(m[f"s_{k}"] or 1.0) for k, c in enumerate(columns)}


def _products(df: DataFrame, a: list[Column], b: list[Column]) -> np.ndarray:
    """Sums over all rows of the products of each of a with each of b."""
    row = df.agg(*[F.sum(x * y).alias(f"p_{i}_{j}") for i, x in enumerate(a) for j, y in enumerate(b)]).first()
    return np.array(row, float).reshape(len(a), len(b))


def _weighted(columns: list[Column], weights: np.ndarray) -> Column:
    return sum((c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def _fitted(landmarks: DataFrame, health: list[str], centre: np.ndarray, scale: np.ndarray, danger: list[float]) -> tuple[np.ndarray, ...] | None:
    """Landmarks, row means of their kernel, its mean, components, and the danger point among them; fitted in one task of
    at most MAX_ROWS rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = (pdf.sort_values("_id")[health].to_numpy(float) - centre) / scale
        full = kernel(x, x)
        mean, every = full.mean(0), full.mean()
        full -= mean
        full -= mean[:, None]
        full += every
        value, vector = np.linalg.eigh(full)
        top = np.argsort(-value)[: min(COMPONENTS, len(x) - 1) or 1]
        parts = vector[:, top] / np.sqrt(np.maximum(value[top], 1e-12))
        point = project((np.array([danger]) - centre) / scale, x, mean, every, parts)
        return pd.DataFrame({"model": [pickle.dumps((x, mean, every, parts, point))]})

    row = landmarks.groupBy(F.lit(1).alias("_g")).applyInPandas(lambda p: run(p), "model binary").first()
    return None if row is None else pickle.loads(row["model"])


def kernel(a: np.ndarray, x: np.ndarray, gamma: float = GAMMA) -> np.ndarray:
    gap = (a * a).sum(1)[:, None] + (x * x).sum(1) - 2 * a @ x.T
    return np.exp(-gamma * np.maximum(gap, 0, out=gap))


def project(a: np.ndarray, x: np.ndarray, mean: np.ndarray, every: float, parts: np.ndarray) -> np.ndarray:
    """Rows of a on the components of the landmarks x."""
    k = kernel(a, x)
    return (k - k.mean(1)[:, None] - mean + every) @ parts


def boundary_stress(df: DataFrame, id_col: str, health: list[str], danger: list[float]) -> DataFrame:
    """(id, distance, boundary): distance from the danger point in kernel space; boundary stress is 1 at the point and 0
    at the farthest bank."""
    rows = df.select(F.col(id_col).alias("_id"), *[_known(c, F.lit(0.5)).alias(c) for c in health])
    m = rows.agg(*[F.avg(c) for c in health], *[F.stddev_pop(c) for c in health]).first()
    empty = rows.select(F.col("_id").alias(id_col), F.lit(0.0).alias("distance"), F.lit(0.0).alias("boundary")).where("false")
    if m[0] is None:
        return empty
    centre, scale = np.array(m[: len(health)], float), np.array(m[len(health) :], float)
    scale = np.where(scale > 0, scale, 1)
    x, mean, every, parts, point = _fitted(rows.orderBy(F.xxhash64("_id"), "_id").limit(MAX_ROWS), health, centre, scale, danger)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 500):  # a kernel of 500 rows has 20 MB
                part = pdf.iloc[k : k + 500]
                own = project((part[health].to_numpy(float) - centre) / scale, x, mean, every, parts)
                yield pd.DataFrame({"_id": part["_id"], "distance": np.sqrt(((own - point) ** 2).sum(1))})

    far = rows.mapInPandas(run, f"_id {dict(rows.dtypes)['_id']}, distance double")
    most = max(far.agg(F.max("distance")).first()[0], 1e-12)
    return far.select(F.col("_id").alias(id_col), "distance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / most)).alias("boundary"))


def kernel_components(df: DataFrame, id_col: str, health: list[str], danger: list[float], count: int = COMPONENTS) -> DataFrame:
    """(id, pc1 to pc<count>): the components of each row in kernel space, fitted as for boundary_stress. Each has the sign
    with which the danger point is at 0 or more on it; components beyond those that there are, are 0."""
    rows = df.select(F.col(id_col).alias("_id"), *[_known(c, F.lit(0.5)).alias(c) for c in health])
    m = rows.agg(*[F.avg(c) for c in health], *[F.stddev_pop(c) for c in health]).first()
    names = [f"pc{k + 1}" for k in range(count)]
    if m[0] is None:
        return rows.select(F.col("_id").alias(id_col), *[F.lit(0.0).alias(n) for n in names]).where("false")
    centre, scale = np.array(m[: len(health)], float), np.array(m[len(health) :], float)
    scale = np.where(scale > 0, scale, 1)
    x, mean, every, parts, point = _fitted(rows.orderBy(F.xxhash64("_id"), "_id").limit(MAX_ROWS), health, centre, scale, danger)
    parts = parts * np.where(point[0] >= 0, 1.0, -1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                own = project((part[health].to_numpy(float) - centre) / scale, x, mean, every, parts)
                own = np.column_stack([own[:, :count], np.zeros((len(part), max(0, count - own.shape[1])))])
                yield pd.DataFrame(dict(zip(names, own.T, strict=True))).assign(_id=part["_id"].to_numpy())[["_id", *names]]

    return rows.mapInPandas(run, f"_id {dict(rows.dtypes)['_id']}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("_id", id_col)


def oriented_stress(df: DataFrame, id_col: str, components: list[str], rank: str) -> DataFrame:
    """(id, oriented): from 0 to 1, 1 where the rank is least. Rows with a rank have that of their own, the others what a ridge
    regression on the components, over the rows that have one, predicts. Where fewer than half of the rows have a rank, the
    first component counts in place of it, its least value as 1."""
    rows = df.select(F.col(id_col).alias("_id"), *[_known(c, F.lit(0.0)).alias(c) for c in components], _known(rank).alias("_rank"))
    n, ranked, centre = rows.agg(F.count(F.lit(1)), F.count("_rank"), F.avg("_rank")).first()
    if not n or 2 * ranked < n:
        told = rows.select("_id", (-F.col(components[0])).alias("raw"))
    else:
        some = rows.where("_rank is not null")
        means = some.agg(*[F.avg(c) for c in components]).first()
        z = [F.col(c) - F.lit(m) for c, m in zip(components, means, strict=True)]
        sums = _products(some, z, [*z, F.col("_rank") - F.lit(centre)])
        weights = np.linalg.solve(sums[:, :-1] + ALPHA * np.eye(len(z)), sums[:, -1])
        told = rows.select("_id", (F.lit(float(n)) - F.coalesce("_rank", _weighted(z, weights) + F.lit(centre))).alias("raw"))
    ends = told.agg(F.min("raw"), F.max("raw")).first()
    low, high = (0.0, 0.0) if ends[0] is None else ends
    return told.select(F.col("_id").alias(id_col), ((F.col("raw") - low) / (high - low + 1e-10)).alias("oriented"))


def pca_stress(df: DataFrame, id_col: str, columns: list[str], orient: str) -> DataFrame:
    """(id, score): the first principal component of standardised columns, turned so that `orient` adds to it, scaled to
    0 to 1. Missing values are the column's median."""
    rows = df.select(F.col(id_col).alias("_id"), *[_known(c).alias(c) for c in columns])
    n = rows.agg(F.count(F.lit(1)), *[F.count(c) for c in columns]).first()
    if gaps := [c for c, k in zip(columns, n[1:], strict=True) if k < n[0]]:
        middle = rows.agg(*[F.median(c) for c in gaps]).first()
        rows = rows.select("_id", *[F.coalesce(c, F.lit(float(middle[gaps.index(c)] or 0))).alias(c) if c in gaps else F.col(c) for c in columns])
    if not n[0]:
        return rows.select(F.col("_id").alias(id_col), F.lit(0.0).alias("score"))
    z = list(_standard(rows, columns).values())
    first = np.linalg.eigh(_products(rows, z, z))[1][:, -1]
    first = first * (1 if first[columns.index(orient)] >= 0 else -1)
    scored = rows.select(F.col("_id").alias(id_col), _weighted(z, first).alias("score"))
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    return scored.withColumn("score", (F.col("score") - low) / max(high - low, 1e-12))


def ridge_orientation(df: DataFrame, id_col: str, columns: list[str], target: str) -> DataFrame:
    """(id, oriented): the target predicted from the columns, scaled to 0 to 1; rows without target are not fitted."""
    rows = df.select(F.col(id_col).alias("_id"), *[_known(c, F.lit(0.5)).alias(c) for c in columns], _known(target).alias("_y")).where("_y is not null")
    centre = rows.agg(F.avg("_y")).first()[0]
    if centre is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0.0).alias("oriented"))
    z = list(_standard(rows, columns).values())
    sums = _products(rows, z, [*z, F.col("_y") - F.lit(centre)])
    weights = np.linalg.solve(sums[:, :-1] + ALPHA * np.eye(len(z)), sums[:, -1])
    told = rows.select(F.col("_id").alias(id_col), (_weighted(z, weights) + F.lit(centre)).alias("oriented"))
    low, high = told.agg(F.min("oriented"), F.max("oriented")).first()
    return told.withColumn("oriented", (F.col("oriented") - low) / (high - low + 1e-10))
