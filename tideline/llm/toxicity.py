"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Lengths of the n-grams in characters of the lower-cased text, and the bits of a hashed feature.
NGRAMS, FEATURE_BITS = (4, 5, 6, 8), 20
#: Labelled rows of each class that the classifier is trained on at most: a bounded sample, in the order of a hash of the
#: id. Their texts are read whole, as for scores.
SAMPLE_ROWS = 4000
#: Features with a weight: those whose shares in the two classes differ most clearly. Their number, their lengths and the
#: penalty L2 were compared by threefold cross-validation over the labels that may be learnt from, of few documents (33 toxic)
#: and of more (305): these have the best recall with few, and of those that have the best AUC and fewest false positives
#: with either. Held-out labels had no part in it.
FEATURES = 2000
SMOOTH, L2, STEPS, RATE = 1.0, 0.2, 150, 0.05
THRESHOLD = 0.7


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, one for each place, A-Z lower-cased and with a space at either end."""
    b = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    b = b + np.uint32(32) * ((b >= 65) & (b <= 90))
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in NGRAMS:
            out.append(((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Classifier:
    """score = sigmoid(bias + sum of the weights of the features that a text has). Weights are those learnt by logistic
    regression times the log-count ratios that scaled the features."""

    def __init__(self, which: np.ndarray, weights: np.ndarray, bias: float):
        self.which, self.weights, self.bias, self._table = which, weights, bias, None

    def __getstate__(self):
        return self.which, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        if self._table is None:
            self._table = np.zeros(1 << FEATURE_BITS, np.int32)
            self._table[self.which] = np.arange(1, len(self.which) + 1)
        at = self._table[features(text)]
        has = np.zeros(len(self.which) + 1, bool)
        has[at] = True
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[has[1:]].sum(), -30, 30))))


def one_class(n1: int, n0: int) -> Classifier:
    """With one class only, every score is that class's share (0 or 1 smoothed)."""
    return Classifier(np.empty(0, np.int64), np.empty(0), float(np.log((n1 + 1) / (n0 + 1))) - (3.0 if not n1 else -3.0))


def choose(df: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """The features with a weight and their log-count ratios, by the counts of clean and toxic texts that have each."""
    ratio = np.log((df[1] + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((df[0] + SMOOTH) / (n0 + 2 * SMOOTH))
    share = (df[0] + df[1] + 1) / (n0 + n1 + 2)
    clear = np.abs(df[1] / n1 - df[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    which = np.sort(np.argsort(-clear, kind="stable")[:FEATURES])
    return which, ratio[which]


def numbers(which: np.ndarray) -> np.ndarray:
    """The place in `which` of every feature, or -1."""
    out = np.full(1 << FEATURE_BITS, -1, np.int32)
    out[which] = np.arange(len(which))
    return out


def present(number: np.ndarray, text: str | None) -> np.ndarray:
    """The places of the features that a text has."""
    x = number[features(text)]
    return np.unique(x[x >= 0])


def learn(which: np.ndarray, ratio: np.ndarray, has: list[np.ndarray], y: np.ndarray) -> Classifier:
    """Logistic regression on the places of the features that each text has."""
    n1, n0 = int(y.sum()), int((~y).sum())
    col, row = np.concatenate(has), np.repeat(np.arange(len(has)), [len(h) for h in has])
    value, w, b = ratio[col], np.zeros(len(which)), float(np.log(n1 / n0))
    m, v = np.zeros(len(which) + 1), np.zeros(len(which) + 1)
    for step in range(1, STEPS + 1):  # full-batch gradient descent with adaptive rates
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, value * w[col], len(has)), -30, 30)))
        gap = (p - y) / len(has)
        g = np.append(np.bincount(col, value * gap[row], len(which)) + L2 * w / len(has), gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(which.astype(np.int64), w * ratio, float(b))


def fit(texts: list[str], toxic: list[int]) -> Classifier:
    """Trains on whole lists."""
    y = np.array(toxic, bool)
    n1, n0 = int(y.sum()), int((~y).sum())
    if not n1 or not n0:
        return one_class(n1, n0)
    df = np.zeros((2, 1 << FEATURE_BITS))
    for t, k in zip(texts, y.astype(int), strict=True):
        df[k, np.unique(features(t))] += 1
    which, ratio = choose(df, n1, n0)
    number = numbers(which)
    return learn(which, ratio, [present(number, t) for t in texts], y)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean, toxic): the texts of a task that have each feature."""
    df = None
    for b in batches:
        for y, t in zip(b.column("y").to_pylist(), b.column("text"), strict=True):
            df = np.zeros((2, 1 << FEATURE_BITS), np.int32) if df is None else df
            df[y, np.unique(features(t.as_py()))] += 1
    if df is not None:
        at = np.flatnonzero(df.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, df[0, at], df[1, at])], names=["feature", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Trains on at most sample_rows labelled documents of each class. Rows without label or id are left out; ids that
    are labelled twice count as toxic if either label says so; of rows that share an id the least text counts; null texts
    count as empty. The bias is that of the classes' shares among all labels, whatever the sample holds of each. Other columns
    have any name; without labels, or with those of one class, all texts get one score.

    Texts stay in the tasks that read them: the driver gets one row per feature, at most 2 ** FEATURE_BITS, and then the
    chosen features of each sampled row."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = None
    for k in (0, 1):
        part = known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * sample_rows ids and labels are broadcast; the rows found are written, as they are read three times
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    rows = Scratch(docs.sparkSession, "toxicity").table(rows.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return one_class(n1, n0)
    found = rows.select("y", "text").mapInArrow(_counts, "feature int, clean int, toxic int").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    df = np.zeros((2, 1 << FEATURE_BITS))
    df[:, found["feature"].to_numpy()] = found["clean"].to_numpy(), found["toxic"].to_numpy()
    which, ratio = choose(df, n1, n0)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers(which)
        for b in batches:
            has = [present(number, t.as_py()).astype("<u2").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(has, pa.binary())], names=["id", "y", "has"])

    kind = docs.schema[id_col].dataType.simpleString()
    # the classes are sampled at rates of their own where one has more than sample_rows
    labelled = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = float(np.log(max(labelled[1] / sample_rows, 1)) - np.log(max(labelled[0] / sample_rows, 1)))
    told = rows.select("id", "y", "text").mapInArrow(chosen, f"id {kind}, y int, has binary").toArrow().sort_by([("id", "ascending"), ("has", "ascending")])
    model = learn(which, ratio, [np.frombuffer(h, "<u2").astype(np.int64) for h in told["has"].to_pylist()], told["y"].to_numpy().astype(bool))
    return Classifier(model.which, model.weights, model.bias + shift)


def toxicity_scores(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with all their columns and score_col, from 0 to 1, of the whole text. Null texts count as empty; an
    existing column of that name is replaced. An empty table gives no rows."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([model.score(x) for x in t], dtype="float64")

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(score_col, F.pandas_udf(score, "double")(F.col(text_col)))
