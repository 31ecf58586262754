"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all texts that may be learnt from are made in the tasks that read them and added up by bucket. The matrix of
log-probabilities has at most CELLS numbers and is broadcast; texts are scored in batches of sparse counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trim

#: Lengths of the n-grams in code points, and bits of a hashed one.
NGRAMS, BITS = (1, 2, 3, 4), 16
#: Numbers of the matrix at most: with more languages, buckets are folded in two until it fits. No language is left out.
CELLS = 1 << 22
SMOOTH = 0.5
#: Code points that are hashed at once, and counts that are scored at once.
PIECE, BATCH = 1 << 20, 1 << 19
#: Languages whose counts a task holds at once.
HELD = 64
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The normalised code points of a text, a piece at a time, with how many of them the last piece had too: lower case,
    every run of other code points than letters one space, and a space at either end."""
    letters, text = _letters(), text.lower()
    held, seen, after = np.full(1, 32, np.uint32), 0, False
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        of = letters[c]
        kept = np.where(of, c, np.uint32(32))[of | np.concatenate(([after], of[:-1]))]
        after = bool(of[-1])
        end = np.full(1 if after and at + PIECE >= len(text) else 0, 32, np.uint32)
        held = np.concatenate((held, kept, end))
        yield held, seen
        held = held[-(max(NGRAMS) - 1) :]
        seen = len(held)


def buckets(text: str) -> np.ndarray:
    """How many n-grams of a text hash to each bucket. Those of spaces only don't count."""
    out = np.zeros(1 << BITS, np.int64)
    for c, seen in _pieces(text):
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
            if n in NGRAMS:
                new = h[max(0, seen - n + 1) :]
                if n == 1:
                    new = new[c[seen:] != 32]
                out += np.bincount((((new ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)), minlength=1 << BITS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """log_p: a row for each bucket, a column for each language. Buckets of BITS bits are folded to those of the matrix."""

    def __init__(self, langs: list[str], prior: np.ndarray, log_p: np.ndarray):
        self.langs, self.prior, self.log_p = langs, prior, log_p

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its probability) of each text."""
        out, at, which, count, starts, held = [(UNKNOWN, 0.0)] * len(texts), [], [], [], [], 0

        def score() -> None:
            if not at:
                return
            total = np.add.reduceat(np.concatenate(count)[:, None] * self.log_p[np.concatenate(which)], starts) + self.prior
            best = total.argmax(1)
            share = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
            for i, b, s in zip(at, best.tolist(), share.tolist(), strict=True):
                out[i] = (self.langs[b], s)

        for i, text in enumerate(texts):
            if not self.langs or not has_letter(text):
                continue
            n = fold(buckets(text), len(self.log_p))
            full = np.flatnonzero(n)
            at.append(i)
            starts.append(held)
            which.append(full)
            count.append(n[full].astype(np.float64))
            held += len(full)
            if held * len(self.langs) >= BATCH:
                score()
                at, which, count, starts, held = [], [], [], [], 0
        score()
        return out


def fold(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts of fewer buckets: those with the same lowest bits are added up."""
    return counts.reshape(-1, size).sum(0)


def matrix_rows(langs: int, cells: int = CELLS) -> int:
    """The buckets of the matrix: the largest power of two with which it has at most `cells` numbers."""
    size = 1 << BITS
    while size * langs > cells and size > 1:
        size >>= 1
    if size * langs > cells:
        raise ValueError(f"more than {cells} languages")
    return size


def fit(langs: list[str], texts: np.ndarray, counts: np.ndarray) -> Model:
    """From the texts of each language, and the counts of each bucket (a row) and language (a column)."""
    if not langs:
        return Model([], np.empty(0), np.empty((1, 0)))
    smooth = counts + SMOOTH
    return Model(langs, np.log(texts / texts.sum()), np.log(smooth / smooth.sum(0)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): the counts of a task's texts; bucket -1 has the number of texts."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            lang, text = lang.as_py(), text.as_py()
            if lang not in held:
                if len(held) == HELD:
                    yield from told()
                    held.clear()
                held[lang] = np.zeros((1 << BITS) + 1, np.int64)
            held[lang][0] += 1
            held[lang][1:] += buckets(text)
    yield from told()
    trim()


def train(docs: DataFrame, known: Column | None = None, lang_col: str = "lang", text_col: str = "text", cells: int = CELLS) -> Model:
    """Learns from all rows where `known` is true, but for those without language or text. Repeated rows count each. The
    driver gets one row for each language, and one for each number of the matrix that isn't zero."""
    rows = docs if known is None else docs.where(known)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    scratch = Scratch(docs.sparkSession, "langid")
    counts = scratch.table(rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    first = counts.where("bucket = -1")
    size = matrix_rows(first.count(), cells)
    texts = {r["lang"]: r["n"] for r in first.collect()}
    langs = sorted(texts, key=lambda x: x.encode("utf-8", "surrogatepass"))
    number = {x: k for k, x in enumerate(langs)}
    folded = counts.where("bucket >= 0").groupBy("lang", F.expr(f"bucket & {size - 1}").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((size, len(langs)))
    if folded.num_rows:
        lang = folded["lang"].combine_chunks().dictionary_encode()
        column = np.array([number[x] for x in lang.dictionary.to_pylist()])[lang.indices.to_numpy()]
        table[folded["bucket"].to_numpy(), column] = folded["n"].to_numpy()
    return fit(langs, np.array([texts[x] for x in langs], float), table)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The documents with all their columns, the likeliest language and its probability, of the whole text.

    `und` and 0 where the text is null or has no letter, or nothing was learnt; equal probabilities go to the language
    that is first by UTF-8 bytes. Existing columns of those names are replaced. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame(sent.value.predict(t.tolist()), columns=["lang", "score"])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    got = docs.withColumn("__got", F.pandas_udf(run, "lang string, score double")(F.col(text_col)))
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    return got.select(*kept, F.col("__got.lang").alias(lang_col), F.col("__got.score").alias(score_col))
