"""Packing of tokenised documents into sequences of balanced cost."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim
from .merges import Merges

LENGTH, END_ID = 4096, 2
#: Cost of a piece of n tokens, linear and quadratic: attention stays within a document.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens that are packed together. It bounds a task's memory and sets over how many sequences cost is balanced.
GROUP_TOKENS = 1 << 21
#: Words that a Python worker keeps the ids of (some 200 MB), and bytes of texts that it tokenises at once.
CACHE_WORDS, CHUNK_BYTES = 1_000_000, 2_000_000
_SEQUENCES = 33  # bits of a sequence's number within its task


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def _plain(word: bytes) -> bool:
    """Whether a word, its A-Z lower-cased, is one piece that the tokenizer leaves as it is: lower-case letters in normal
    form. Bytes are letters where they are those of ASCII."""
    if word.isalpha():
        return True
    text = word.decode("utf-8")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


class WordIds:
    """Ids of whole texts, put together from those of their words.

    The tokenizer's pieces never reach across ASCII white space, so the ids of a text are those of its words in turn,
    and each distinct word is encoded once: words of plain letters, also with one full stop or comma behind them, by
    the tokenizer's merges over many words at once, and all others by the tokenizer itself.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        self.merges = Merges.of_json(path)
        self.known: dict[bytes, bytes] = {}
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def _learn(self, words: list[bytes]) -> None:
        some, rest = [], []
        for w in words:
            (some if _plain(w) else rest).append(w)
        ids, n = self.merges.encode(some)
        ids, at = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
        self.known.update(zip(some, [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        for w, e in zip(rest, self.tokenizer.encode_batch([w.decode("utf-8") for w in rest], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Words are numbered, so that Python handles each
        distinct one once, and ids are put together as arrays."""
        if isinstance(texts, list):
            texts = pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # A-Z; the tokenizer lowers the rest
        coded = split.flatten().dictionary_encode()
        # by way of numpy, which makes Python's bytes ten times as fast as pyarrow
        words, number = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        self.known[b""] = b""  # what stands before white space at the beginning of a text, or behind it at the end
        each = list(map(self.known.get, words))
        if new := {w for w, ids in zip(words, each, strict=True) if ids is None}:
            stems = {w: w[:-1] for w in new if w[-1] in b".," and _plain(w[:-1])}
            self._learn([w for w in new.difference(stems).union(stems.values(), (b".", b",")) if w not in self.known])
            for w, stem in stems.items():
                self.known[w] = self.known[stem] + self.known[w[-1:]]
            each = [self.known[w] if ids is None else ids for w, ids in zip(words, each, strict=True)]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        every, first = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size
        sizes = size[number]
        ends = np.cumsum(sizes)
        ids = every[np.arange(len(ends) and ends[-1]) + np.repeat(first[number] - (ends - sizes), sizes)]
        bounds = np.concatenate((np.zeros(1, np.int64), ends))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[x:y].tobytes() + self.end for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def _coder(path: str, end_id: int | None) -> WordIds:
    """One for each Python worker, which goes on from task to task with the words it knows."""
    return WordIds(path, end_id)


def assign(lengths: list[int], limit: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Packs documents: (document, start, length, sequence, offset) for each piece. Every sequence is full.

    What a document has beyond whole sequences of its own is in the pool. The pool gets as many whole sequences as it
    fills, and for the remainder one of each power of two that it is the sum of, which needs no padding. Documents go
    in descending order of length to the sequence of lowest cost that has room, or, if none has, as far as room goes to
    the lowest and on to the next.
    """
    out, seq, pool = [], 0, []
    for d, n in enumerate(lengths):
        for k in range(n // limit):
            out.append((d, k * limit, limit, seq, 0))
            seq += 1
        if n % limit:
            pool.append((n % limit, d, n - n % limit))
    total = sum(n for n, _, _ in pool)
    rooms = [limit] * (total // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if (total % limit) >> b & 1]
    room, spent = np.array(rooms, np.int64), np.zeros(len(rooms))
    for n, d, start in sorted(pool, key=lambda x: (-x[0], x[1])):
        while n:
            s = int(np.where(room >= n, spent, np.inf).argmin())  # of equal costs the first
            if room[s] < n:
                s = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(n, int(room[s]))
            out.append((d, start, take, seq + s, rooms[s] - int(room[s])))
            room[s] -= take
            spent[s] += cost(take)
            start, n = start + take, n - take
    return out


_OUT = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, limit: int = LENGTH, keep_words: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids and end_id lie in exactly one piece each; sequences have `limit` tokens, a power of two, or a
    smaller power of two. A null or empty text is its end_id alone. Rows that share an id are packed each for itself.
    No row is shuffled: a task packs the documents of its own input split, GROUP_TOKENS at a time, so that a repeated
    task packs alike as long as its input rows come in the same order, as from a table. With keep_words a worker keeps the
    words it knows from task to task, which is faster; without, other stages have the memory. Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path, end_id)
        first = TaskContext.get().partitionId() << _SEQUENCES
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, tokens
            pieces = assign([len(ids) // 4 for _, ids in held], limit)
            cols = list(zip(*((held[d][0], start, n, held[d][1][4 * start : 4 * (start + n)], len(held[d][1]) // 4, first + seq, offset) for d, start, n, seq, offset in pieces), strict=True)) or [[]] * 7
            first += max((p[3] + 1 for p in pieces), default=0)
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text")
            reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ids):  # a long text is a chunk of its own
                end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + CHUNK_BYTES, "right")))
                for i, coded in zip(ids[at:end], coder.encode(texts.slice(at, end - at)), strict=True):
                    if coded:
                        held.append((i, coded))
                        tokens += len(coded) // 4
                    if tokens >= GROUP_TOKENS:
                        yield flush()
                at = end
        if held:
            yield flush()
        if not keep_words:
            coder.known = {}
        trim()

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
