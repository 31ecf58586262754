"""The divergence of sources against plain integers, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import divergence
from tideline.llm.common import Scratch


def plain(rows, min_docs=3, top=200):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    has, n, of = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        has[lang].update(set(terms))
        n[lang, source].update(terms)
        of[lang].add(source)
    out = []
    for lang, sources in of.items():
        kept = [t for t, k in has[lang].items() if k >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(n[lang, s]) for s in sources}
        whole = share(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            far = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, f(p[s][t], whole[t])) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", far, len(far)), ("term", more, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in divergence.source_divergence(df, **more).collect())


def test_random_rows(spark):
    draw = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = []
    for _ in range(400):
        lang, source = draw.choice(["en", "en", "fr", None]), draw.choice(["a", "a", "a", "b", "c", None, "é"])
        rows.append((" ".join(draw.choices(words, [1 / (k + 1) for k in range(300)], k=draw.randrange(40))).title(), lang, source))
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = plain(rows)
    assert got(df) == want
    assert got(df, sorted_rows=5) == want  # the selection goes down to the last bit, and into ties
    assert got(df, top=7, sorted_rows=7) == plain(rows, top=7)


def test_odd_rows(spark):
    """Nulls, texts without terms, one source, repeated rows, long texts, long terms, other scripts, clashing names; an empty table."""
    rows = [(None, None, None), ("", "", "b"), ("12 _-@[`{\x7f", "xx", "a"), ("alone", "yy", "a"), *[("Straße ÀB àb 日本 " * 3, "de", "a")] * 3, *[("x" * 5000 + " y", "de", "b")] * 3, ("x" * 5000 + " y y ÀB", "de", "c"), ("Long words " * 100_000, "de", "c")]
    clash = ["n", "docs", "term", "p", "q", "item", "value", "rank", "v", "total", "part"]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(df.select("*", *[F.lit("clash").alias(c) for c in clash])) == plain(rows)
    assert got(df.where("false")) == []


def test_a_text_is_split_alike_at_any_size(monkeypatch):
    text = " ".join(f"Wörter{k:c} und-mehr" for k in range(200, 900))
    whole = [w for ws in divergence.terms_of(text) for w in ws]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for ws in divergence.terms_of(text) for w in ws] == whole and b"und" in whole


def test_counts_of_small_tasks_are_the_same(monkeypatch):
    rows = [("en", f"s{k % 2}", f"aa bb cc{k % 3:c} dd dd") for k in range(60)] + [("fr", "", "")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])

    def told():
        out, parts = Counter(), list(divergence._counted(iter([batch, batch])))
        for p in parts:
            for r in p.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out, len(parts)

    whole, once = told()
    monkeypatch.setattr(divergence, "HELD", 1)
    many, often = told()
    assert many == whole and often > once == 3 and whole["en", "s0", "dd", "n"] == 120 and whole["fr", "", None, "docs"] == 0


def test_top_terms_with_ties(spark):
    """Many rows of one value, with common prefixes of their items, and groups smaller than k."""
    draw = random.Random(5)
    rows = [("g", 1 << 59, f"{'p' * 20}{k:05d}") for k in range(700)] + [("g", (1 << 59) + draw.randrange(9), f"q{k}") for k in range(40)] + [("h", draw.randrange(1 << draw.randrange(1, 60)), f"é{k}") for k in range(500)] + [("i", 0, "z")] + [("j", 5, "same")] * 60
    df = spark.createDataFrame(rows, "g string, value long, item string")
    for k, most in ((50, 60), (30, 30), (1, 1), (200, 4096)):
        out = divergence.top_terms(df, ["g"], "value", "item", k, Scratch(spark, "t"), most).collect()
        want = []
        for g in "ghij":
            own = sorted(((v, i) for x, v, i in rows if x == g), key=lambda x: (-x[0], x[1].encode()))[:k]
            want += [(g, v, i, r + 1) for r, (v, i) in enumerate(own)]
        assert sorted((r.g, r.value, r.item, r["rank"]) for r in out) == sorted(want)


def test_shares_beyond_long_sums(spark):
    """Counts whose product with the scale is beyond 64 bits."""
    df = spark.createDataFrame([(10**13, 10**14, 10**6)], "n long, total long, v long")
    assert df.select(divergence._share("n", "total", "v").alias("p")).collect()[0].p == 1 + 10**9 * (10**13 + 1) // (10**14 + 10**6)
