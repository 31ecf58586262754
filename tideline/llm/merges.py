"""Ranked merges over many words at once, in arrays."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import numpy as np

_NONE = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of byte-level pieces: itself where it is printable in
    Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Words of one length are the rows of an array; each step joins, in every row, the neighbours of lowest rank, the
    leftmost of equals, until no row has two neighbours that merge."""

    #: Bytes of words that are folded together, and of a word that is folded for itself, in time that grows with n log n.
    CELLS, LONG = 1 << 19, 256

    def __init__(self, pairs: dict[int, int], ids: np.ndarray, single: np.ndarray, last: np.ndarray, whole: dict[bytes, int]):
        """pairs: left id << 32 | right id -> rank; ids: what each rank makes; single, last: the id of a byte, and of
        one at a word's end; whole: words that have an id at once."""
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.ids, self.single, self.last, self.whole = ids, single, last, whole
        self._table: dict[int, int] | None = None

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """For a rank file: any two pieces that make a third may merge, in the order of its rank."""
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        return cls(pairs, np.arange(max(ranks.values()) + 1, dtype=np.int32), single, single, ranks)

    @classmethod
    def of_json(cls, path: str) -> Merges:
        """For a tokenizer file with a vocabulary, a list of merges and a suffix at the end of words."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        both = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        pairs = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in reversed([*enumerate(both)])}
        letters = byte_letters()
        return cls(pairs, np.array([vocab[a + b] for a, b in both], np.int32), np.array([vocab[x] for x in letters], np.int32), np.array([vocab[x + end] for x in letters], np.int32), {})

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.found[at], _NONE).astype(np.int32)

    def _fold(self, t: np.ndarray, put) -> None:
        """put(rows, ids) gets the ids of rows that are done."""
        rows, r = np.arange(len(t)), np.full(t.shape, _NONE, np.int32)
        r[:, :-1] = self._rank(t[:, :-1], t[:, 1:])
        while len(rows):
            at = r.argmin(1)
            every = np.arange(len(rows))
            low = r[every, at]
            over = low == _NONE
            if over.any():
                put(rows[over], t[over])
                t, r, rows, at, low = (x[~over] for x in (t, r, rows, at, low))
                every = every[: len(rows)]
                if not len(rows):
                    return
            t[every, at] = self.ids[low]
            col = np.arange(t.shape[1] - 1)
            # every row loses one column; the ranks on both sides of the merge are looked up anew
            t = np.take_along_axis(t, col + (col > at[:, None]), 1)
            r = np.take_along_axis(r, col + (col >= at[:, None]), 1)
            end = t.shape[1] - 1
            for side in (at - 1, at):
                ok = (side >= 0) & (side < end)
                k, c = every[ok], side[ok]
                r[k, c] = self._rank(t[k, c], t[k, c + 1])
            r[:, end] = _NONE

    def _fold_long(self, t: np.ndarray) -> np.ndarray:
        """The ids of one long word: a heap of the places of neighbours that merge, by rank, then place."""
        if self._table is None:
            self._table = dict(zip(self.keys.tolist(), self.found[:-1].tolist(), strict=True))
        rank, ids, n = self._table.get, t.tolist(), len(t)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._rank(t[:-1], t[1:]).astype(np.int64)
        at = np.flatnonzero(first != _NONE)
        heap = (first[at] << 32 | at).tolist()
        heapq.heapify(heap)
        while heap:
            low, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            # places that have gone, or that have another neighbour since
            if ids[i] < 0 or j == n or rank(ids[i] << 32 | ids[j]) != low:
                continue
            ids[i], ids[j], after[i] = int(self.ids[low]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, r << 32 | a)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, none of them empty, one word after another, and how many each has."""
        by_length, at, found, counts = defaultdict(list), [], [], []
        for k, w in enumerate(words):
            whole = self.whole.get(w)
            if whole is None:
                by_length[len(w)].append(k)
            else:
                at.append(k)
                found.append(whole)
        at, found, counts = [np.array(at, np.int64)], [np.array(found, np.int32)], [np.ones(len(at), np.int64)]
        for n, every in by_length.items():
            if n > self.LONG:
                for k in every:
                    b = np.frombuffer(words[k], np.uint8)
                    ids = self._fold_long(np.append(self.single[b[:-1]], self.last[b[-1]]))
                    at.append(np.array([k], np.int64))
                    found.append(ids)
                    counts.append(np.array([len(ids)], np.int64))
                continue
            step = max(1, self.CELLS // n)
            for a in range(0, len(every), step):
                part = np.array(every[a : a + step], np.int64)
                b = np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8).reshape(-1, n)
                t = self.single[b]
                t[:, -1] = self.last[b[:, -1]]

                def put(rows: np.ndarray, ids: np.ndarray, part: np.ndarray = part) -> None:
                    at.append(part[rows])
                    found.append(ids.ravel())
                    counts.append(np.full(len(rows), ids.shape[1], np.int64))

                self._fold(t, put)
        at, found, counts = (np.concatenate(x) for x in (at, found, counts))
        order = np.argsort(at)  # each word is there once
        n = counts[order]
        ends = np.cumsum(n)
        return found[np.arange(len(found)) + np.repeat((np.cumsum(counts) - counts)[order] - (ends - n), n)], n
