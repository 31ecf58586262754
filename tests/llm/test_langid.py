"""Language identification against a plain classifier, on odd rows, and held out."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid
from tideline.llm.queries import QUERIES


def plain_buckets(text, size=1 << langid.BITS):
    """Bucket counts by loops over strings."""
    low = text.lower()
    words = "".join(c if c.isalpha() else " " for c in low).split()
    s = " " + "".join(w + " " for w in words)
    out = Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(s) - n + 1):
            if n > 1 or s[i] != " ":
                h = 0
                for c in s[i : i + n]:
                    h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                out[((((h ^ n) * 0x9E3779B1) & 0xFFFFFFFF) >> 16) % size] += 1
    return out


class Plain:
    def __init__(self, rows, size=1 << langid.BITS):
        self.size, self.of, self.texts = size, {}, Counter()
        for text, lang in rows:
            if text is not None and lang is not None:
                self.of.setdefault(lang, Counter()).update(plain_buckets(text, size))
                self.texts[lang] += 1

    def predict(self, text):
        if not self.of or not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        n, logs = plain_buckets(text, self.size), {}
        for lang, c in self.of.items():
            whole = sum(c.values()) + langid.SMOOTH * self.size
            logs[lang] = math.log(self.texts[lang] / sum(self.texts.values())) + sum(k * math.log((c[b] + langid.SMOOTH) / whole) for b, k in n.items())
        best = min(logs, key=lambda x: (-logs[x], x.encode()))
        return best, 1 / sum(math.exp(max(v - logs[best], -700)) for v in logs.values())


ROWS = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "THE END, of it!", "en"), (3, "THE END, of it!", "en"), (4, None, "fr"), (5, "", "fr"), (6, "12 - 7", "de"), (7, "der Hund und die Katze", None), (8, "Ünd Ärger İ", ""), (None, "no id", "en"), (9, "ça va bien " * 200, "fr"), (10, "日本語 テキスト", "ja")]


@pytest.mark.parametrize("cells", [1 << 22, 640])
def test_same_as_the_plain_classifier(spark, cells):
    """Nulls, empty texts, no letters, repeated rows, clashing names; with few cells, buckets are folded."""
    clash = ["lang", "score", "lang_pred", "bucket", "n", "__got"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = langid.train(df.select("*", F.lit("x").alias("bucket"), F.lit("x").alias("n")), cells=cells)
    assert model.log_p.size <= cells and model.langs == ["", "de", "en", "fr", "ja"]
    plain = Plain([r[1:] for r in ROWS], len(model.log_p))
    out = langid.identify(df.select("doc_id", "text", *[F.lit("clash").alias(c) for c in clash if c != "__got"]), model).collect()
    assert len(out) == len(ROWS)
    want = sorted((str(i), *plain.predict(t)) for i, t, _ in ROWS)
    for r, (i, lang, share) in zip(sorted((str(r.doc_id), r.lang_pred, r.score, r.lang) for r in out), want, strict=True):
        assert r[:2] == (i, lang) and abs(r[2] - share) < 1e-6 and r[3] == "clash"


def test_nothing_to_learn_or_to_score(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    nothing = langid.train(df.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(df.where("false"), langid.train(df)).count() == 0


def test_a_text_counts_alike_in_any_pieces(monkeypatch):
    text = "Ein 12 lan--ger Text, ohne Ende? " * 50 + "x" * 40
    whole = langid.buckets(text)
    assert {int(b): int(whole[b]) for b in np.flatnonzero(whole)} == dict(plain_buckets(text))
    for size in (1, 2, 3, 5, 64):
        monkeypatch.setattr(langid, "PIECE", size)
        assert (langid.buckets(text) == whole).all()


def test_languages_are_counted_in_turns(monkeypatch):
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": t} for _, t, lang in ROWS if lang is not None and t is not None])

    def told():
        out, parts = Counter(), list(langid._counted(iter([batch, batch])))
        for p in parts:
            for r in p.to_pylist():
                out[r["lang"], r["bucket"]] += r["n"]
        return out, len(parts)

    whole, once = told()
    monkeypatch.setattr(langid, "HELD", 1)
    many, often = told()
    assert many == whole and often > once and whole["en", -1] == 8


def test_op13(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    plain = Plain([(t, lang) for i, t, lang in rows if not held(i)])
    out = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, sf).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        lang, share = plain.predict(t)
        assert (out[i].held_out, out[i].lang_pred) == (held(i), lang) and abs(out[i].score - share) < 1e-6


def test_op13_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-zA-Z]'").select("doc_id", "lang")
    rows = QUERIES["op13_language_id"](spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.99
