"""Pairs of names whose set_ratio reaches a threshold, by an equi-join of signatures; exact, and without comparing all.

Write A and B for the lengths of two names' distinct words, joined, and r for the threshold (of 200 per cent). The best
ratio of a pair is one of two kinds.

- Common words and the rest of either name, one after the other, against each other: then they have r (A + B) letters in
  common and in order, so that of their pairs of neighbouring letters (with a space at either end, and in any order of
  words) at least 1 + (3 r - 1)(A + B) are the same. So the first few of such pairs by a common order, all but that many
  and two more, have two in common: names meet on every two of those.
- Common words against one of the names: then the words that are not common have at most a share of (1 - 2 r) / (1 - r)
  of that name. So any of its words that have more than this between them have a common one: names meet on these, the rarest.

Any order of pairs and any choice of words gives all matches; the rarest first give few others.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Commonest pairs of letters and words whose order is learnt from the known names; the others count as rare. It bounds
#: what is sent to tasks, and has no effect on results.
LEARNT = 4096


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit parallelism."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_length(a, b) / n


def sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@functools.lru_cache(maxsize=1 << 16)
def _words(a: str) -> frozenset[str]:
    return frozenset(a.split())


def set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the common words, and those with either text's rest; 100 where one text's words are all common.
    What is below `least` may come back as any smaller number."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both = x & y
    if both and (len(both) == len(x) or len(both) == len(y)):
        return 100.0
    # the common words begin either text, so only the rests have to be compared
    base = sum(map(len, both)) + len(both)
    dx, dy = " ".join(sorted(x - both)), " ".join(sorted(y - both))
    left, right = base + len(dx), base + len(dy)
    best = 200.0 * (base - 1) / (base - 1 + min(left, right)) if both else 0.0
    if 200.0 * (base + min(len(dx), len(dy))) / (left + right) > max(best, least - 1e-9):
        best = max(best, 200.0 * (base + common_length(dx, dy)) / (left + right))
    return best


def ratios(a: Column, b: Column) -> Column:
    """struct(set_ratio, sort_ratio) of two columns of names, in Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            pairs = [(set_ratio(p or "", q or ""), sort_ratio(p or "", q or "")) for p, q in zip(x, y, strict=True)]
            yield pd.DataFrame(pairs, columns=["set_ratio", "sort_ratio"], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "set_ratio double, sort_ratio double")(a, b)


def letter_pairs(words: list[str]) -> list[tuple[str, int]]:
    """The pairs of neighbouring letters of distinct words, each with how many like it came before."""
    text = f" {' '.join(words)} "
    seen: Counter[str] = Counter()
    out = []
    for k in range(len(text) - 1):
        pair = text[k : k + 2]
        out.append((pair, seen[pair]))
        seen[pair] += 1
    return out


def common_pairs(n: int, least: int) -> int:
    """How many letter pairs a name of length n has in common with any partner of the first kind, at least."""
    shortest = -(-least * n // (200 - least))  # what the partner's length is at least
    return 1 + -(-(3 * least - 200) * (n + shortest) // 200)


def telling_words(words: list[str], least: int, rank: dict[str, int]) -> list[str]:
    """The rarest words of a name, as many as can't all be missing in a partner of the second kind."""
    n, weight, out = len(" ".join(words)), 0, []
    for w in sorted(words, key=lambda w: (rank.get(w, -1), -len(w), w)):
        out.append(w)
        weight += len(w) + 1
        if weight * (200 - least) > n * (200 - 2 * least):
            break
    return out


def signatures(name: str, least: int, pair_rank: dict[str, int], word_rank: dict[str, int], known: bool) -> Iterator[str]:
    """The keys on which a name meets its partners; the keys of known names mirror those of asked ones."""
    words = sorted(set(name.split()))
    pairs = sorted(letter_pairs(words), key=lambda p: (pair_rank.get(p[0], -1), p))
    first = pairs[: len(pairs) - common_pairs(len(pairs) - 1, least) + 2]
    for (a, i), (b, j) in combinations(first, 2):
        yield f"0{a}{i},{b}{j}"
    some, every = ("2", "1") if known else ("1", "2")
    for w in telling_words(words, least, word_rank):
        yield some + w
    for w in words:
        yield every + w


def _ranks(names: DataFrame, parts) -> dict[str, int]:
    rows = names.select(F.explode(parts).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(LEARNT).collect()
    return {r.x: len(rows) - k for k, r in enumerate(rows)}


def _signed(names: DataFrame, column: str, least: int, pair_rank: dict[str, int], word_rank: dict[str, int], known: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some = b[column].iloc[at : at + 500]
                rows = [(x, len(" ".join(set(x.split()))), s) for x in some for s in signatures(x, least, pair_rank, word_rank, known)]
                yield pd.DataFrame(rows, columns=[column, f"{column}_size", "key"])

    return spread(names, column).mapInPandas(run, f"{column} string, {column}_size int, key string")


def candidate_pairs(asked: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(asked, known), each pair once: all pairs of names of asked (asked) and known (known) with a set_ratio of `least` or
    more, and some others. Names are compared by their words, split at white space; null and blank ones match nothing.
    `least` is a whole per cent above 66, since names without any letters in common reach less."""
    if 3 * least <= 200:
        raise ValueError("names of a lower ratio may have nothing in common to meet on")
    a = asked.select("asked").where("trim(asked) <> ''").distinct()
    k = known.select("known").where("trim(known) <> ''").distinct()
    padded = F.concat(F.lit(" "), "known", F.lit(" "))
    pair_rank = _ranks(k.select("known"), F.transform(F.sequence(F.lit(1), F.length("known") + 1), lambda i: F.substring(padded, i, F.lit(2))))
    word_rank = _ranks(k.select("known"), F.split("known", r"\s+"))
    left = _signed(a, "asked", least, pair_rank, word_rank, False)
    right = _signed(k, "known", least, pair_rank, word_rank, True)
    # lengths bound the ratio where names meet on letters
    fit = ~F.col("key").startswith("0") | (200 * F.least("asked_size", "known_size") >= least * (F.col("asked_size") + F.col("known_size")))
    return spread(left.join(right, "key").where(fit).select("asked", "known"), "asked", "known").dropDuplicates()


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by columns to as many tasks as there are cores, or shuffle partitions if those are more: what is done
    with each takes long for its size, by which adaptive execution would gather them in few."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def scored(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, set_ratio, sort_ratio) of the pairs that reach `least`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, q, s, sort_ratio(p, q)) for p, q in zip(batch[a], batch[b], strict=True) if (s := set_ratio(p, q, least)) >= least]
            yield pd.DataFrame(rows, columns=[a, b, "set_ratio", "sort_ratio"])

    return pairs.select(a, b).mapInPandas(run, f"{a} string, {b} string, set_ratio double, sort_ratio double")


def similar(asked: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(asked, known, set_ratio, sort_ratio) of the candidate pairs that reach `least`."""
    return scored(candidate_pairs(asked, known, least), "asked", "known", least)
