"""Lempel-Ziv phrase fingerprints: documents that compress alike have many dictionary phrases in common."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_hashes

#: Minimum hashes in a signature: the standard error of a likeness is at most 1 / (2 sqrt(SLOTS)).
SLOTS = 256
#: Documents in a range of ids, and ranges at most: the driver knows one id of each.
RANGE_ROWS, MAX_RANGES = 1000, 20_000
_NONE = 0xFFFF


def phrases(text: str, known: set[str] | None = None, start: str = "") -> tuple[set[str], str]:
    """Lempel-Ziv 78 parse: each phrase is the longest known one and the next code point.

    Returns the phrases and what is left at the end. `known` (changed in place) and `start` go on with an earlier
    parse, so that texts with a common beginning are parsed once up to where they part.
    """
    known = set() if known is None else known
    add, p = known.add, start
    for c in text:
        p += c
        if p not in known:
            add(p)
            p = ""
    return known, p


def signature(known: set[str], rest: str = "") -> np.ndarray:
    """One minimum hash of 16 bits for each slot that the phrases are dealt to; empty slots hold 65535."""
    out = np.full(SLOTS, _NONE, np.uint16)
    every = [*known]
    if rest and rest not in known:
        every.append(rest)
    if every:
        h = np.sort(string_hashes(every))
        slot, first = np.unique(h >> np.uint64(56), return_index=True)  # in order, so the first is the least
        out[slot.astype(np.int64)] = (h[first] & np.uint64(0xFFFFFFFF)) % np.uint64(_NONE)
    return out


def fingerprint(text: str | None) -> np.ndarray:
    return signature(*phrases(text or ""))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots filled in either signature that agree; 1 for two empty ones."""
    filled = (a != _NONE) | (b != _NONE)
    n = int(filled.sum())
    return float(((a == b) & filled).sum()) / n if n else 1.0


def _text(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Range:
    """Goes down one range of ids, document by document, and pairs each with the one before it."""

    def __init__(self) -> None:
        self.rng, self.last = None, None

    def step(self, rng: int, guest: bool, doc_id: int | None, text: str) -> tuple | None:
        """The finished row of the document before this one, if any."""
        if rng != self.rng:
            self.rng, self.last = rng, None
        if self.last is None and guest:
            return None  # a further row with the id of the guest that was used already
        half = len(text) - len(text) // 2
        known, rest = phrases(text[:half])
        ahead = (known.copy(), rest) if not guest else None
        print_ = signature(*phrases(text[half:], known, rest))
        row = None
        if self.last:
            own_id, own, own_print, state = self.last
            n = len(own) // 2
            edited = own[: len(own) - n] + text[:n]
            other = signature(*phrases(text[:n], *state))
            row = (own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _text(own_print), _text(other), likeness(own_print, other), likeness(own_print, print_))
        self.last = None if guest else (doc_id, text, print_, ahead)
        return row


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = _Range()
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _OUT.split(", ")])
    for b in batches:
        rows = [r for args in zip(*(b.column(c).to_pylist() for c in ("rng", "guest", "id", "text")), strict=True) if (r := at.step(*args))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(n).type) for n, x in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: fingerprint of its text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document
    in descending order of ids; the first document follows the last. Rows that share an id go by text; null ids come
    last; null texts count as empty. A lone document is its own next one. Other columns, whatever their names, are ignored; an
    empty table gives no rows.

    Texts are shuffled once, by ranges of ids. The first document of each range also goes to the range before it.
    """
    rows = docs.count()
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, min(MAX_RANGES, rows // range_rows))
    cuts = sorted({int(x) for x in base.where("id is not null").approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []

    def place(ids: pd.Series) -> pd.Series:
        """Ranges count from 0 at the largest ids; nulls are in the last."""
        at = len(cuts) - np.searchsorted(np.array(cuts, np.int64), ids.fillna(-(1 << 63)).astype("int64").to_numpy(), side="left")
        return pd.Series(at.astype("int32"))

    ranged = base.withColumn("rng", F.pandas_udf(place, "int")(F.col("id")))
    heads = sorted((r["rng"], r["top"]) for r in ranged.select("rng", "id").groupBy("rng").agg(F.max("id").alias("top")).collect())  # one row per range
    before = {top: heads[k - 1][0] for k, (_, top) in enumerate(heads) if top is not None}
    tops = sorted(before)

    def guest_of(ids: pd.Series) -> pd.Series:
        out = []
        for x in ids:
            k = -1 if pd.isna(x) else bisect_left(tops, x)
            out.append(before[tops[k]] if 0 <= k < len(tops) and tops[k] == x else None)
        return pd.Series(out, dtype="Int32")

    if heads and heads[0][1] is None:  # ids are all null, and there is one range
        guests = F.lit(heads[0][0])
    else:
        guests = F.pandas_udf(guest_of, "int")(F.col("id"))
    place_of = F.array(F.struct(F.col("rng").alias("rng"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("rng"), F.lit(True).alias("guest")))
    dealt = ranged.withColumn("guest_of", guests).select("id", "text", F.explode(F.filter(place_of, lambda p: p["rng"].isNotNull())).alias("p")).select("p.rng", "p.guest", "id", "text")
    walked = dealt.repartition("rng").sortWithinPartitions("rng", "guest", F.desc_nulls_last("id"), "text").mapInArrow(_walk, _OUT)
    return walked.withColumnRenamed("id", id_col)
