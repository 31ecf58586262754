"""The similarity join of names against all pairs, and resolution against a plain loop over its passes."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.expr import company_key
from tideline.operators import matching as M
from tideline.operators import similar as N

LETTERS = "AAABBCDEEÉ 日"


def odd_names(seed: int, n: int) -> list[str]:
    """Random names of 1 to 40 letters, and misspelt, shortened, lengthened and shuffled copies."""
    draw = random.Random(seed)
    out = ["A", "AB", "A A", " A  AB ", "LTD", "TATA STEEL LTD", "STEEL TATA LTD", "TATA STEEEL LTD", "TATA LTD"]
    while len(out) < n:
        if draw.random() < 0.5:
            x = "".join(draw.choices(LETTERS, k=draw.randint(1, 40)))
        else:
            x = list(draw.choice(out))
            for _ in range(draw.randint(0, 6)):
                at = draw.randrange(len(x) + 1)
                x[at : at + draw.randint(0, 1)] = draw.choices(LETTERS, k=draw.randint(0, 1))
            x = "".join(x).split()
            draw.shuffle(x)
            x = " ".join(x[: draw.randint(1, 9)] + draw.choices(["LTD", "INDIA", "X"], k=draw.randint(0, 2)))
        if x.strip():
            out.append(x)
    return out


@pytest.mark.parametrize("least", [67, 80, 88, 96])
def test_same_as_all_pairs(spark, least):
    a, b = odd_names(1, 220), odd_names(2, 220)
    want = {(x, y) for x in set(a) for y in set(b) if N.set_ratio(x, y) >= least}
    frame = lambda names, c: spark.createDataFrame([(x,) for x in [*names, None, "", "  "]], f"{c} string")
    out = N.similar(frame(a, "asked"), frame(b, "known"), least)
    rows = out.collect()
    assert {(r.asked, r.known) for r in rows} == want and len(rows) == len(want) > 50
    assert all(r.set_ratio == N.set_ratio(r.asked, r.known) and r.sort_ratio == N.sort_ratio(r.asked, r.known) for r in rows)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bounds():
    """No pair above a threshold has fewer letter pairs in common than the bound, or misses all telling words."""
    names = [" ".join(sorted(set(x.split()))) for x in odd_names(3, 160)]
    for least in (67, 80, 90):
        for x in names:
            for y in names:
                if N.set_ratio(x, y) >= least:
                    met = set(N.signatures(x, least, {}, {}, False)) & set(N.signatures(y, least, {}, {}, True))
                    assert met, (x, y, least)


def test_low_ratios_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], "asked string, known string")
    with pytest.raises(ValueError, match="lower ratio"):
        N.similar(df, df, 66)
    assert N.similar(df.where("false"), df, 80).count() == 0 and N.similar(df, df.where("false"), 80).count() == 0


def plain_resolution(names, banks, companies, key):
    """(entity, kind, passed) of each name by loops over all known names."""
    last = lambda rows: {k: max(e for e, n in rows if key[n] == k) for k in {key[n] for _, n in rows} if k}
    bank, company = last(banks), last(companies)
    generic = set(M.GENERIC)
    distinct = lambda w: len(w) > 1 and w not in generic

    def generic_only(a, b):
        x, y = a.split(" "), b.split(" ")
        both = set(x) & set(y)
        return bool(both) and (not any(map(distinct, x)) or not any(map(distinct, y)) or not any(map(distinct, both)) or 100 * sum(not distinct(w) for w in both) > M.GENERIC_SHARE * len(both))

    out = {}
    for raw in names:
        k = key[raw]
        if not k:
            out[raw] = (None, "none", None)
        elif k in bank or k in company:
            out[raw] = (bank[k], "Bank", 1) if k in bank else (company[k], "Company", 2)
        else:
            words = [w for part in k.split(" ") for w in part.split("-") if distinct(w)]
            scored = sorted((-N.set_ratio(k, o), -N.sort_ratio(k, o), e, o) for o, e in company.items() if words and words[0] in o)
            best = scored[0] if scored else None
            short = [e for e, n in banks if n.upper() == raw and len(raw) <= M.ABBREVIATION and all(c.isalpha() or c == "&" for c in raw)]
            if best and -best[0] >= M.SET_RATIO and -best[1] >= M.SORT_RATIO and not generic_only(k, best[3]):
                out[raw] = (best[2], "Company", 3)
            else:
                out[raw] = (min(short), "Bank", 4) if short else (None, "none", None)
    return out


def test_resolution_same_as_a_loop(spark):
    draw = random.Random(9)
    words = ["Tata", "Steel", "Bajaj", "Finance", "India", "Muthoot", "Capital", "Reliance", "Power", "Infra", "Group", "Sun", "Moon", "Su", "Ab"]
    make = lambda: " ".join(draw.sample(words, draw.randint(1, 4))) + draw.choice(["", " Ltd", " Limited", " Pvt. Ltd."])
    companies = [(f"c{k}", make()) for k in range(90)]
    banks = [("b1", "HDFC"), ("b2", "Sun Bank"), ("b2", "SUN"), ("b3", "Axis")]

    def misspelt(x):
        at = draw.randrange(len(x))
        return x[:at] + draw.choice(["", "e", "x"]) + x[at + draw.randint(0, 1) :]

    names = list({*[make() for _ in range(60)], *[misspelt(n) for _, n in companies], "HDFC", "SUN", "AXIS", "Ltd", "hdfc", "Sun Bank Ltd"})
    every = [*names, *[n for _, n in banks + companies]]
    key = {r.n: r.k for r in spark.createDataFrame([(n,) for n in every], "n string").select("n", company_key(F.col("n")).alias("k")).collect()}
    want = plain_resolution(names, banks, companies, key)
    frame = lambda rows: spark.createDataFrame(rows, "entity string, known string")
    out = M.resolve(spark.createDataFrame([(n,) for n in names], "name string"), "name", frame(banks), frame(companies))
    assert {r["name"]: (r.entity, None if r.kind is None else r.kind, r.passed) for r in out.collect()} == want
    assert {v[2] for v in want.values()} == {1, 2, 3, None}  # what the fourth pass could find, the first has found
    asked = M.candidates(out, "name", frame(companies))
    open_ = [n for n in names if want[n][1] == "none" and key[n]]
    company = {k: max(e for e, n in companies if key[n] == k) for k in {key[n] for _, n in companies} if k}
    for n in open_:
        first = [w for part in key[n].split(" ") for w in part.split("-") if len(w) > 1 and w not in M.GENERIC][:1]
        scored = sorted((-N.set_ratio(key[n], o), -N.sort_ratio(key[n], o), e) for o, e in company.items() if first and first[0] in o)[:3]
        assert [(r.entity, r.score) for r in asked.where(F.col("name") == n).orderBy("rank").collect()] == [(e, -s) for s, _, e in scored]
        if n != open_[0]:
            break
