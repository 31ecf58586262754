"""The similarity join against all pairs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tideline.llm import ngram_join as J


def brute(rows, words, percent):
    sets = {i: set(J.shingle_hashes(t, words).tolist()) for i, t in rows}
    at, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    for ids in at.values():
        shared.update(combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts(rnd, groups):
    out = []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([1, 3, 6, 12, 25, 60, 150]))]
        for _ in range(rnd.randint(1, 5)):
            v = list(base)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.choice([0, len(v), rnd.randint(0, len(v))])
                v[k:k] = [f"x{rnd.randint(0, 10**6)}"] if rnd.random() < 0.6 else []
                if len(v) > 1 and rnd.random() < 0.4:
                    v.pop(rnd.randrange(len(v)))
            out.append(" ".join(v))
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_components(spark, words, percent):
    rows = near_texts(random.Random(words), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(df, words, percent, block=3).collect()}
    assert got == brute(rows, words, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_every_linked_pair_meets(percent):
    """Random sets just at the threshold have a key of the smaller one's layout in common."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 90, 400, 1500]:
        for _ in range(30):
            h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = rng.integers(0, len(h) * (100 - percent) // 100 + 1)
            more = rng.integers(0, max(1, len(h) * (100 - percent) // 100 + 1))
            g = np.unique(np.concatenate((rng.permutation(h)[: len(h) - drop], rng.integers(0, 2**64, more, dtype=np.uint64))))
            inter = len(np.intersect1d(h, g))
            if not len(g) or 100 * inter < percent * (len(h) + len(g) - inter):
                continue
            b = min(J.band_of(len(h), percent), J.band_of(len(g), percent))
            assert max(J.band_of(len(h), percent), J.band_of(len(g), percent)) <= b + 1
            assert len(np.intersect1d(J.index_keys(h, b, percent), J.index_keys(g, b, percent)))
            differ = int(np.bitwise_count(np.frombuffer(J.sketch(h, b, percent), np.uint8) ^ np.frombuffer(J.sketch(g, b, percent), np.uint8)).sum())
            assert differ <= len(h) + len(g) - 2 * inter


def test_met_over_batches(monkeypatch):
    import pyarrow as pa

    rows = [(1, 5), (1, 5), (1, 6), (2, 1), (3, 1), (3, 1), (4, 2), (4, 3), (4, 4), (9, 9), (257, 5), (257, 6)]
    want = {frozenset((5, 6)), frozenset((2, 3, 4))}
    for held in (1_000_000, 2, 1):
        monkeypatch.setattr(J, "HELD", held)
        for size in range(1, 13):
            batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]]), pa.array([s for _, s in rows[i : i + size]])], names=["key", "sid"]) for i in range(0, len(rows), size)]
            groups = defaultdict(set)
            for b in J._met(iter(batches)):
                for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    groups[k].add(s)
            assert {frozenset(g) for g in groups.values()} == want
            if held == 1_000_000:
                assert sorted(k & 0xFF for k in groups) == [1, 4]  # keys of one layout with the same sets are one group
