"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding concatenates binary pieces.

`encode_word` is the fold in Spark's higher-order functions, with a literal rank map. It takes about 100 microseconds a
word, so `encode_texts`, for whole tables, folds the same merges over all distinct words of a block at once in arrays
(README, op6, has the figures). Nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trim
from .merges import Merges

#: Code points of a block: its distinct words are encoded once. A longer text is a block of its own.
BLOCK_CHARS = 12_000_000
#: Buckets of the rank map. Spark looks maps up by going through them, so they are kept short.
BUCKETS = 1 << 15
#: Texts that are Python strings at once, and texts in an output batch.
OUT_ROWS = 1000
_BIG = 1 << 30


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@functools.lru_cache(maxsize=1)
def load_merges(path: str) -> Merges:
    """One for each Python worker, which goes on from task to task with it."""
    return Merges.of_ranks(load_ranks(path))


@functools.lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in load_ranks(path).items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return json.dumps(buckets, separators=(",", ":"))


def rank_map(spark: SparkSession, path: str) -> Column:
    """The literal rank map, as a one-row subquery: as a bare literal it would be printed wherever Spark prints a plan."""
    return spark.createDataFrame([(_rank_json(path),)], "json string").select(F.from_json("json", "array<map<string,int>>").alias("ranks")).scalar()


def encode_word(word: Column, table: Column) -> Column:
    """The ids of a word (binary) as array<int>, with `table` a column that holds rank_map.

    The fold's state is the places in the word's hex string where pieces begin, and its end; joining two neighbours
    takes the place between them away. Each step joins the neighbours of lowest rank, the leftmost of equals, until no
    two neighbours are a token.
    """
    def rank(h: Column, start: Column, end: Column) -> Column:
        piece = F.substring(h, start + 1, end - start)
        return let(piece, lambda x: F.try_element_at(F.get(table, F.crc32(x.cast("binary")).bitwiseAND(BUCKETS - 1).cast("int")), x))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def best(h: Column, p: Column) -> Column:
        """Rank and place of the next merge in one number."""
        pairs = F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: F.shiftleft(F.coalesce(rank(h, F.get(p, i), F.get(p, i + 2)), F.lit(_BIG)).cast("long"), 31).bitwiseOR(i.cast("long")))
        return F.when(F.size(p) < 3, F.lit(_BIG << 31)).otherwise(F.array_min(pairs))

    def fold(h: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            gone = F.get(acc["p"], acc["b"].bitwiseAND((1 << 31) - 1).cast("int") + 1)
            # the first step, from no places, sets the state up
            p = F.when(acc["b"] < 0, F.sequence(F.lit(0), F.length(h), F.lit(2))).otherwise(F.array_remove(acc["p"], gone))
            return F.when(acc["b"] >= _BIG << 31, acc).otherwise(let(p, lambda q: F.struct(q.alias("p"), best(h, q).alias("b"))))

        none = F.struct(F.array().cast("array<int>").alias("p"), F.lit(-1).cast("long").alias("b"))
        places = F.aggregate(F.sequence(F.lit(0), (F.length(h) / 2).cast("int")), none, step)["p"]
        return let(places, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(h, F.get(p, i), F.get(p, i + 1))))

    return let(F.hex(word), lambda h: let(rank(h, F.lit(0), F.length(h)), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(h))))


_SPLIT, _ODD = re.compile(r"(?= \S)"), re.compile(r" (?=\s|\Z)")


def _numbers() -> defaultdict:
    """Gives each new key the next number."""
    d = defaultdict()
    d.default_factory = d.__len__
    return d


def _gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `values` that `which` names, one after another, and the length of each."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[which] - (ends - n), n)], n


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


class _Block:
    """Texts as numbers of chunks: runs without a space inside, which hold whole matches of the pattern."""

    def __init__(self) -> None:
        self.ids, self.docs, self.chunk_no, self.chars = [], [], _numbers(), 0

    def add(self, doc_id: int | None, text: str) -> None:
        if _ODD.search(text):  # a space before other white space belongs with it
            keys = [p[1:] if k and p[:1] == " " else (p,) for k, p in enumerate(_SPLIT.split(text))]
        else:
            keys = text.split(" ")
            keys[0] = (keys[0],)
        self.docs.append(np.fromiter(map(self.chunk_no.__getitem__, keys), np.int32, len(keys)))
        self.ids.append(doc_id)
        self.chars += len(text)

    def _words(self, pieces_of) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words, the numbers of those of all chunks, one chunk after another, and how many each has."""
        word_no, flat, counts = _numbers(), [], []
        for c in self.chunk_no:  # keys are chunks behind a space, or tuples of those without one
            found = pieces_of(c[0] if type(c) is tuple else " " + c)
            counts.append(len(found))
            flat.extend([word_no[x] for x in found])
        return [w.encode("utf-8", "replace") for w in word_no], np.array(flat, np.int64), np.array(counts, np.int64)

    def chunk_tokens(self, merges: Merges, pieces_of) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of each chunk."""
        words, flat, counts = self._words(pieces_of)
        n = merges.encode(words)[1][flat] if words else flat
        at = _starts(n)[_starts(counts)]
        return np.array([len(c[0]) if type(c) is tuple else len(c) + 1 for c in self.chunk_no], np.int64), np.diff(at)

    def encode(self, merges: Merges, pieces_of) -> Iterator[pa.RecordBatch]:
        words, flat, counts = self._words(pieces_of)
        word_ids, word_n = merges.encode(words)
        piece_ids, piece_n = _gather(_starts(word_n)[:-1], word_n, word_ids, flat)
        chunk_at = _starts(piece_n)[_starts(counts)]
        chunk_n = np.diff(chunk_at)
        for k in range(0, len(self.docs), OUT_ROWS):
            docs = self.docs[k : k + OUT_ROWS]
            ids, n = _gather(chunk_at[:-1], chunk_n, piece_ids, np.concatenate(docs))
            ends = 4 * _starts(n)[_starts(np.array([len(d) for d in docs]))]
            data = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[k : k + OUT_ROWS], pa.int64()), pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["id", "ids"])


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids): the ids of each text as little-endian unsigned 32-bit integers, as of the ranks in the file `path`,
    each match of `pattern` for itself and without special tokens.

    A null or empty text has no ids (empty binary). Repeated rows come back repeated. The pattern must not match across
    the beginning of a space and a non-space, as patterns of this kind do not. The cost of a single word of n
    bytes grows with n log n. Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pieces_of, block = load_merges(path), regex.compile(pattern).findall, _Block()
        for b in (x.slice(k, OUT_ROWS) for x in batches for k in range(0, x.num_rows, OUT_ROWS)):
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if block.ids and block.chars + len(text) > block_chars:
                    yield from block.encode(merges, pieces_of)
                    block = _Block()
                block.add(doc_id, text)
        if block.ids:
            yield from block.encode(merges, pieces_of)
        trim()

    return base.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes of ids as encode_texts gives them: the binary pieces, concatenated. Null gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = [p for p, _ in sorted(load_ranks(path).items(), key=lambda x: x[1])]
        for b in batches:
            yield pd.Series([None if x is None else b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(ids)
