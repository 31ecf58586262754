"""Queries that SQL can't express, over the smallest tables, against plain Python; and the pipeline's stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bpe, toxicity
from tideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
WHITE = "[\\x20\\x09-\\x0D]"


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})


@pytest.fixture(scope="module")
def learnt():
    """Labels that may be learnt from."""
    rows = duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SF}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY doc_id").fetchall()
    return {i: y for i, y in rows if zlib.crc32(str(i).encode()) % 3 != 1}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def pieces_are(rows, want):
    """Whether pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) hold each document's ids once."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and sum(p.length for p in parts) == len(want[i])
        for r in parts:
            assert r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(np.array(want[i][r.start : r.start + r.length], "<u4").tobytes())
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        n = sum(r.length for r in parts)
        assert n <= 4096 and n & (n - 1) == 0


def word_ids(texts):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}


def near_groups(texts, words, percent):
    """The least id that links of shingle sets reach from each document."""
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    at, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    for ids in at.values():
        shared.update(combinations(sorted(ids), 2))
    least = {i: i for i in sets}
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return least


def without_repeated_lines(texts):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"^{WHITE}+|{WHITE}+$", "", x))
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    gone = lambda i, x: len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}


def test_op2(spark, texts, coder):
    for r in QUERIES["op2_token_counts"](spark, SF).collect():
        t = texts[r.doc_id]
        third = len(t) // 3
        once = t[:third] + "an edit, here" + t[third + 12 :]
        at = min(2 * third, len(once))
        twice = once[:at] + " and there " + once[at:]
        assert r.edited_sha256 == sha(twice) and r.n_tokens == len(coder.encode_ordinary(t)) and r.n_tokens_edited == len(coder.encode_ordinary(twice))


def test_op3(spark, texts):
    pieces_are(QUERIES["op3_packing"](spark, SF).collect(), word_ids(texts))


WORD = (1 << 64) - 1


def spread(x):
    """The finaliser of splitmix64."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & WORD
    return x ^ x >> 31


def plain_print(text):
    """256 slots of a Lempel-Ziv 78 parse by way of a trie, and the hash of a phrase as a sum over its code points."""
    root, node, hashes = {}, None, []
    base = 0x9E3779B97F4A7C15 | 5
    node, depth, total, power = root, 0, 0, 1
    for c in text:
        total = (total + (ord(c) + 1) * power) & WORD
        power = power * base & WORD
        depth += 1
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            hashes.append(spread((total + depth) & WORD))
            node, depth, total, power = root, 0, 0, 1
    if depth:  # what is left is a phrase that is known, or its beginning
        hashes.append(spread((total + depth) & WORD))
    out = [None] * 256
    for h in sorted(hashes, reverse=True):
        out[h >> 56] = (h & 0xFFFFFFFF) % 0xFFFF
    return out


def plain_likeness(a, b):
    either = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def test_op4(spark, texts):
    order = sorted(texts, reverse=True)
    hex_ = lambda print_: "".join(f"{0xFFFF if x is None else x:04x}" for x in print_)
    prints = {i: plain_print(t) for i, t in texts.items()}
    rows = QUERIES["op4_lz_fingerprints"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        after = order[(order.index(r.doc_id) + 1) % len(order)]
        a, b = texts[r.doc_id], texts[after]
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        edited = plain_print(e)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), sha(e), hex_(prints[r.doc_id]), hex_(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(prints[r.doc_id], edited), plain_likeness(prints[r.doc_id], prints[after])))


def test_op6(spark, texts, coder):
    rows = QUERIES["op6_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id]))


def plain_grams(text):
    """The hashed n-grams that a text has."""
    low = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in f" {text} "]
    out = set()
    for n in toxicity.NGRAMS:
        for k in range(len(low) - n + 1):
            h = 0
            for c in low[k : k + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            out.add(((h ^ n) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.FEATURE_BITS)
    return out


def plain_classifier(grams, toxic):
    """Weights and bias: ratios by counting, the clearest features by sorting, and regression on a whole matrix."""
    n1 = sum(toxic.values())
    n0 = len(toxic) - n1
    has = [Counter(), Counter()]
    for i, y in toxic.items():
        has[y].update(grams[i])
    ratio, clear = {}, {}
    for x in set(has[0]) | set(has[1]):
        a, b = has[1][x], has[0][x]
        ratio[x] = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
        share = (a + b + 1) / (n0 + n1 + 2)
        clear[x] = abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    chosen = sorted(sorted(clear, key=lambda x: (-clear[x], x))[: toxicity.FEATURES])
    ids = sorted(toxic)
    m = np.array([[ratio[x] * (x in grams[i]) for x in chosen] for i in ids])
    y = np.array([toxic[i] for i in ids], float)
    w = np.append(np.zeros(len(chosen)), np.log(n1 / n0))
    one = np.column_stack([m, np.ones(len(ids))])
    decay = np.append(np.full(len(chosen), toxicity.L2 / len(ids)), 0)
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for k in range(1, toxicity.STEPS + 1):
        g = one.T @ (1 / (1 + np.exp(-np.clip(one @ w, -30, 30))) - y) / len(ids) + decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - toxicity.RATE * mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return {x: v * ratio[x] for x, v in zip(chosen, w[:-1], strict=True)}, w[-1]


def test_op7_as_the_plain_classifier(spark, texts, learnt):
    grams = {i: plain_grams(t) for i, t in texts.items()}
    weights, bias = plain_classifier(grams, {i: int(y) for i, y in learnt.items() if i in texts})
    rows = QUERIES["op7_toxicity"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score = 1 / (1 + np.exp(-np.clip(bias + sum(weights.get(x, 0.0) for x in grams[r.doc_id]), -30, 30)))
        assert abs(r.score - score) < 1e-4 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)


def test_op7_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = QUERIES["op7_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.7 and np.mean([r.predicted for r in clean]) <= 0.01


def test_pipeline_against_plain_stages(spark, texts, learnt):
    import corpus_pipeline

    known = [i for i in learnt if i in texts]
    model = toxicity.fit([texts[i] for i in known], [learnt[i] for i in known])
    left = {i: t for i, t in texts.items() if model.score(t) < toxicity.THRESHOLD}
    left = without_repeated_lines(left)
    least = near_groups(left, 5, 80)
    left = {i: t for i, t in left.items() if least[i] == i}
    pieces_are(corpus_pipeline.run(spark, SF).collect(), word_ids(left))


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_join", "packing"])
def test_stages_on_odd_documents(spark, name):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names, and an empty table."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, "no id", None, None, None), (1, None, "en", "web", None), (2, "", None, "web", 0), (3, "same words in both of these rows " * 3, "en", None, 99), (3, "same words in both of these rows " * 3, "en", None, 99), (4, "x" * 50_000 + " y" * 50_000, "en", "web", 150_000)]
    clash = ["id", "key", "n", "sid", "text_hash", "drops", "n_lines", "score", "y", "component_id", "__gone", "pos", "line", "label", "start", "ids"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("clash").alias(c) for c in clash])
    out, none = stage(spark, docs, SF), stage(spark, docs.where("false"), SF)
    assert none.count() == 0 and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {None, 1, 2, 3, 4}
        return
    assert out.columns == docs.columns and len(got) == len(rows)
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), rows, strict=True):
        assert r.doc_id == i and (r.text or "") == (t or "") and r.key == "clash"
