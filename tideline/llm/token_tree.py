"""Token counts that follow edits: a tree of sums over a document's segments, of which an edit re-encodes a few.

A segment begins where a space stands before a non-space, which no match of the tokenizer's pattern reaches across, so
counts of segments add up. A tree is kept as two arrays: where its segments end, and the sums of its subtrees in heap
order (node k has children 2k and 2k + 1; the leaves are the segments).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _Block, load_merges, load_ranks

#: Chunks of a segment when a tree is built, and code points of the texts that are counted together.
SEGMENT_CHUNKS, BLOCK_CHARS = 48, 16_000_000
_SAFE = re.compile(r" (?=\S)")


class Tree:
    """ends: code points from the text's start to each segment's end; sums: subtree sums in heap order."""

    def __init__(self, ends: np.ndarray, sums: np.ndarray):
        self.ends, self.sums, self.size = ends, sums, len(sums) // 2

    @classmethod
    def of(cls, ends: np.ndarray, counts: np.ndarray) -> Tree:
        level = np.zeros(1 << max(0, len(ends) - 1).bit_length(), np.int64)
        level[: len(counts)] = counts
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        return cls(ends, np.concatenate(([0], *reversed(levels))))

    @property
    def total(self) -> int:
        return int(self.sums[1])

    @property
    def counts(self) -> np.ndarray:
        return self.sums[self.size : self.size + len(self.ends)]

    def prefix(self, segment: int) -> int:
        """Tokens of the segments before one."""
        k, out = self.size + segment, 0
        while k > 1:
            if k & 1:
                out += int(self.sums[k - 1])
            k >>= 1
        return out

    def _set(self, segment: int, count: int) -> None:
        k = self.size + segment
        change = count - int(self.sums[k])
        while k:
            self.sums[k] += change
            k >>= 1

    def edit(self, text: str, start: int, end: int, new: str, count) -> tuple[str, int]:
        """Replaces text[start:end] and updates the sums; returns the text and how many code points were re-encoded.

        Those are the segments that the edit touches, and one on either side where the edit reaches a segment's border
        or leaves it no border any more. count(piece) gives a piece's tokens. They become one segment."""
        n = len(self.ends)
        first = min(int(np.searchsorted(self.ends, start, side="right")), max(0, n - 1))
        last = min(int(np.searchsorted(self.ends, end, side="left")), max(0, n - 1))
        begin = lambda k: int(self.ends[k - 1]) if k else 0
        after = text[:start] + new + text[end:]
        grown = len(new) - (end - start)
        while first and (start <= begin(first) + 1 or not _SAFE.match(after, begin(first))):
            first -= 1
        while last < n - 1 and not (end <= self.ends[last] and _SAFE.match(after, int(self.ends[last]) + grown)):
            last += 1
        a, b = begin(first), (int(self.ends[last]) if n else 0) + grown
        # the segments become one, at the place of the first; the others are left empty
        self.ends = self.ends.copy()
        self.ends[first : last + 1] = b
        self.ends[last + 1 :] += grown
        self._set(first, count(after[a:b]))
        for k in range(first + 1, last + 1):
            self._set(k, 0)
        return after, b - a


_TREES = "id long, text string, edits array<struct<start:int,end:int,new:string>>, ends array<int>, sums array<long>"


def build_trees(docs: DataFrame, path: str, pattern: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edits, ends, sums): a tree for each document; `edits` goes along. Each distinct word of a block of
    texts is encoded once, and nothing is shuffled. A null text is empty and has one empty segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pieces_of = load_merges(path), regex.compile(pattern).findall

        def finish(block: _Block, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths, counts = block.chunk_tokens(merges, pieces_of)
            k = 0
            for b in held:
                trees = []
                for d in block.docs[k : k + b.num_rows]:
                    starts = np.arange(0, len(d), SEGMENT_CHUNKS)
                    trees.append(Tree.of(np.cumsum(np.add.reduceat(lengths[d], starts)), np.add.reduceat(counts[d], starts)))
                k += b.num_rows
                more = [pa.array([t.ends for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=["id", "text", "edits", "ends", "sums"])

        block, held = _Block(), []
        for b in batches:
            for part in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                for t in part.column("text").to_pylist():
                    block.add(None, t)
                held.append(part)
                if block.chars >= BLOCK_CHARS:
                    yield from finish(block, held)
                    block, held = _Block(), []
        if held:
            yield from finish(block, held)

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), edits.alias("edits"))
    return base.mapInArrow(run, _TREES)


def edit_trees(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """Applies each document's edits in turn: (id, text, ends, sums, n_tokens before, n_tokens_edited, reencoded_chars).

    An edit replaces text[start:end], in code points of the text as the edits before it left it. Bounds beyond the
    text are cut to it, null ones are its beginning and its end; a null edit or null edits change nothing."""
    schema = "id long, text string, ends array<int>, sums array<long>, n_tokens long, n_tokens_edited long, reencoded_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        count = lambda x: len(coder.encode_ordinary(x))
        for b in batches:
            rows = []
            ends, sums = (b.column(c) for c in ("ends", "sums"))
            for k, (doc_id, text, edits) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "text", "edits")), strict=True)):
                tree = Tree(ends[k].values.to_numpy().astype(np.int64), sums[k].values.to_numpy().copy())
                before, redone = tree.total, 0
                for e in edits or ():
                    if e is not None:
                        start = min(max(0, e["start"] or 0), len(text))
                        end = len(text) if e["end"] is None else min(max(start, e["end"]), len(text))
                        text, n = tree.edit(text, start, end, e["new"] or "", count)
                        redone += n
                rows.append((doc_id, text, tree.ends, tree.sums, before, tree.total, redone))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return trees.mapInArrow(run, schema)


@functools.lru_cache(maxsize=1)
def _coder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("tideline", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def sample_edits(text: Column) -> Column:
    """Two edits for each document: a replacement a third of the way in, and an insertion at two thirds."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    third = (n / 3).cast("int")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("new"))
    return F.array(edit(third, third + 12, "an edit, here"), edit(third * 2, third * 2, " and there "))


def count_edited(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_tokens_edited, edited_sha256 and reencoded_chars of each document under sample_edits. Repeated
    rows come back repeated; other columns, whatever their names, are ignored; an empty
    table gives no rows."""
    out = edit_trees(build_trees(docs, path, pattern, sample_edits(F.col(text_col)), id_col, text_col), path, pattern)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_tokens_edited", F.sha2("text", 256).alias("edited_sha256"), "reencoded_chars")
