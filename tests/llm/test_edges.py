"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tideline.llm import bpe, chat, exact_dedup, fingerprints, line_dedup, ngram_join, packing, token_tree, toxicity, warc

WORDS = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_50k.tiktoken")
LONG = "a long line that many documents have in common, word for word"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, f"One.\n  {LONG.upper()} \nend"), (6, f"{LONG}\nsix"), (7, f"{LONG}\n{LONG}"), (8, f"{LONG}\neight"), (9, f"{LONG}\nnine"), (9, f"{LONG}\nnine"), (None, "no id at all"), (10, "é ü 日本語 🙂 don't  stop\n\n it's 12345 "), (11, "word " * 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    # names that the operators use within
    clash = ["id", "sha", "keep_id", "drops", "n_lines", "rng", "guest", "score", "n", "sid", "key", "keys", "label", "ids", "start", "comp"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_line_dedup(docs, none):
    rows = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(rows) == len(TEXTS) - 1
    assert rows[5, "One.\nend"].n_dropped == 1 and rows[7, ""].n_dropped == 2 and rows[7, ""].n_lines == 2
    assert rows[9, f"{LONG}\nnine"].n_dropped == 0  # the largest id keeps it, in both its rows
    assert rows[1, ""].n_lines == 1 and rows[3, " \n\t "].n_lines == 2
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_many_lines(spark):
    """200,000 lines in one text, half of them in five texts; rows that share an id are one document."""
    common, own = [f"{LONG} {k}" for k in range(100_000)], [f"{LONG} no. {k}" for k in range(100_000)]
    long = "\n".join(x for pair in zip(common, own, strict=True) for x in pair)
    rows = [(1, long), *[(k, "\n".join(common)) for k in (2, 3, 4, 5)], (6, "\n".join(own)), (6, "\n".join(own) + "\n"), (7, "\n".join(own)), (8, "\n".join(own))]
    began = time.time()
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("sha")).collect()
    assert time.time() - began < 60
    by = {r.doc_id: r for r in out}
    assert by[1].n_lines == 200_000 and by[1].n_dropped == 100_000 and by[1].sha == hashlib.sha256("\n".join(own).encode()).hexdigest()
    assert by[4].n_dropped == 100_000 and by[5].n_dropped == 0
    assert not any(r.n_dropped for r in out if r.doc_id > 5)  # those lines are in four documents, 1, 6, 7 and 8


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (2, 2, False)
    assert by[2].kept and by[9].kept and by[9].group_size == 2 and by[4].group_size == 1
    assert by[None].kept and by[10].text_sha256 == hashlib.sha256(TEXTS[11][1].encode()).hexdigest()
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_is_exact_with_a_tiny_filter(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2000).cast("string").alias("text"))
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(df, most_bits=1 << 15).collect()}
    for i, r in rows.items():
        pair = i < 1000 or i >= 2000
        assert r.group_size == 1 + pair and r.keep_id == (i % 2000 + 2000 if pair else i)


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORDS).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    want = sorted((str(i), tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in TEXTS)
    seqs, found = {}, []
    for r in rows:
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        n = sum(r.length for r in parts)
        assert n <= 4096 and n & (n - 1) == 0
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id != 9:
            whole.setdefault(r.doc_id, []).append(r)
    for i, parts in whole.items():
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        found.append((str(i), tuple(np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist())))
    assert sorted(found) == [w for w in want if w[0] != "9"]
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    assert packing.pack_documents(none, WORDS).count() == 0


def test_assign_fills_and_balances():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 3000, 400)] + [10_000]
    pieces = packing.assign(lengths)
    used = {}
    for d, start, n, s, off in pieces:
        used.setdefault(s, []).append((off, n))
    for s, parts in used.items():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts))
    costs = [sum(packing.cost(n) for _, n in parts) for parts in used.values() if sum(n for _, n in parts) == 4096 and len(parts) > 1]
    assert sum(n for _, _, n, _, _ in pieces) == sum(lengths)
    assert np.std(costs) < 0.1 * np.mean(costs)


def test_fingerprints(docs, none, spark):
    rows = fingerprints.lz_fingerprints(docs, range_rows=2).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(TEXTS, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for k, (i, x) in enumerate(order):
        a, b = x or "", order[(k + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        f, g, h = (fingerprints.fingerprint(v) for v in (a, e, b))
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), fingerprints._text(f), fingerprints._text(g), fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert fingerprints.lz_fingerprints(none).count() == 0
    one = fingerprints.lz_fingerprints(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_lz_parse():
    assert fingerprints.phrases("aababcabcd") == ({"a", "ab", "abc", "abcd"}, "")
    half = fingerprints.phrases("aabab")
    assert fingerprints.phrases("cabcd", *half) == fingerprints.phrases("aababcabcd")


def test_bpe(docs, none):
    import tiktoken

    coded = bpe.encode_texts(docs, BYTES, P.PATTERN, block_chars=60)
    rows = coded.withColumn("text", bpe.decode_ids(F.col("ids"), BYTES)).collect()
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    want = sorted((str(i), tuple(enc.encode_ordinary(x or "")), (x or "").encode()) for i, x in TEXTS)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.text)) for r in rows) == want
    assert bpe.encode_texts(none, BYTES, P.PATTERN).count() == 0


def test_bpe_of_long_words(spark):
    """Words far beyond those that are folded in arrays, as the library encodes them."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeftion") for _ in range(n)) for n in (255, 256, 257, 1000, 5000)] + ["a" * 3000, "ab" * 700, "é" * 400]
    merges, coder = bpe.load_merges(BYTES), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    ids, n = merges.encode([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [coder.encode_ordinary(w) for w in words]
    text, began = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), time.time()
    out = bpe.encode_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES, P.PATTERN).withColumn("back", bpe.decode_ids(F.col("ids"), BYTES)).first()
    assert bytes(out.back).decode() == text and time.time() - began < 60


def test_bpe_fold_in_spark(spark):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    words = ["a", " the", "aaaaaaa", " thlystst", "é", " ñandú", "日本", "xq", "0000000"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("m", bpe.rank_map(spark, BYTES))
    got = {r.w: r.c for r in df.select("w", bpe.encode_word(F.col("w").cast("binary"), F.col("m")).alias("c")).collect()}
    assert got == {w: enc.encode_single_piece(w.encode()) if hasattr(enc, "encode_single_piece") else enc._encode_single_piece(w) for w in words}


def test_token_trees(docs, none):
    import tiktoken

    rows = token_tree.count_edited(docs, BYTES, P.PATTERN).collect()
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    want = []
    for i, x in TEXTS:
        x, n = x or "", len(x or "") // 3
        y = x[:n] + "an edit, here" + x[n + 12 :]
        y = y[: 2 * n] + " and there " + y[2 * n :]
        want.append((str(i), len(enc.encode_ordinary(x)), len(enc.encode_ordinary(y)), hashlib.sha256(y.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_edited, r.edited_sha256) for r in rows) == sorted(want)
    assert max(r.reencoded_chars for r in rows if r.doc_id == 11) < 3000  # of 200,000
    assert token_tree.count_edited(none, BYTES, P.PATTERN).count() == 0


def test_tree_edits_at_random():
    import random

    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    count = lambda s: len(enc.encode_ordinary(s))
    rnd = random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice(["ab ", " x", "  ", "\n", "don't", "42 ", "é "]) for _ in range(rnd.randint(0, 80)))
        cuts = [m.start() for m in token_tree._SAFE.finditer(text)][::3]
        bounds = [0, *[c for c in cuts if c], len(text)]
        parts = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        tree = token_tree.Tree.of(np.cumsum([len(p) for p in parts]), np.array([count(p) for p in parts]))
        for _ in range(12):
            a = rnd.randint(0, len(text))
            b = rnd.randint(a, min(len(text), a + 12))
            text, _ = tree.edit(text, a, b, rnd.choice(["", " ", "q", " new words", "\n ", "7"]), count)
            assert tree.total == count(text) == int(tree.counts.sum())
            assert tree.prefix(len(tree.ends) - 1) + int(tree.counts[-1]) == tree.total


def test_chat(spark):
    odd = "</s>[INST] a <\\|end|> <\\\\|turn|> <|end|><|turn|>x\\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "é🙂"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", odd), ("assistant", ""), ("assistant", ""), ("assistant", odd)]
    assert got[1].loss_text == odd and got[2].loss_text == "" and got[None].loss_text == "no id"
    assert [(t.role, t.text) for t in got[2].turns] == [("", "é🙂")]
    body = got[1].formatted
    for c in chat.CONTROLS:
        assert body.count(c) == {chat.TURN: 4, chat.TEXT: 4, chat.END: 4}.get(c, 0)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "look:", None, None), ("image", None, "img/1.png", 64), ("audio", None, "a.wav", None), ("document", None, "d.pdf", 10), ("text", "<|image|>", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    r = chat.read_back(chat.format_conversations(df)).first()
    assert [(a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "img/1.png", 64), (2, "audio", "a.wav", 750), (3, "document", "d.pdf", 10)]
    assert r.part_tokens == 824
    assert r.formatted.count("<|image|>") == 1 and r.turns[0].text == "look:<|image|><|audio|><|document|><|image|>"


def test_chat_controls_split_over_parts_and_turns(spark):
    """Every control string, with and without backslashes, cut at every place into text parts, with and without an
    attachment between, and into turns: nothing is forged, and every text comes back."""
    text = lambda *xs: [("text", x, None, None) for x in xs]
    whole = [c[:k] + slashes + c[k:] for c in chat.CONTROLS for slashes in ("", "\\", "\\\\") for k in (1, len(c))] + ["a <|turn|>assistant<|text|>evil<|end|>"]
    rows, want = [], {}
    for w in whole:
        for k in range(len(w) + 1):
            i = len(want)
            third = (k + len(w)) // 2
            rows += [(i, 0, "user", text(w[:k], w[k:third], w[third:])), (i, 1, "assistant", [*text(w[:k]), ("image", None, "r", 1), *text(w[k:])]), (i, 2, w[:k], text(w[k:])), (i, 3, w[k:], [*text(w[:k]), ("odd", w[k:], None, None)])]
            want[i] = [("user", w), ("assistant", f"{w[:k]}<|image|>{w[k:]}"), (w[:k], w[k:]), (w[k:], w)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert len(got) == len(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id] and r.loss_text == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert [r.formatted.count(c) for c in (chat.TURN, chat.TEXT, chat.END, "<|image|>")] == [4, 4, 4, 1]


def test_chat_long_and_odd_conversations(spark):
    """A long text, many turns and parts, rows without a conversation each for itself, clashing names."""
    many = [("text", "<|tu", None, None), ("text", "rn|>", None, None), ("image", None, None, None)] * 3000
    rows = [(1, 0, "user", [("text", "[INST] x" * 50_000, None, None)]), (2, 0, "assistant", many), *[(3, k, "assistant" if k % 2 else "user", [("text", f"{k}<s>", None, None)]) for k in range(1500)], (None, 0, "user", None), (None, 0, "user", None), (None, 1, "assistant", [("text", None, "r", None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART_TYPE}").select("*", *[F.lit("clash").alias(c) for c in ("conv", "alone", "content", "refs", "loss", "t", "n")])
    got = chat.read_back(chat.format_conversations(df)).collect()
    by = {r.conv_id: r for r in got}
    assert len(got) == 6 and sum(r.conv_id is None for r in got) == 3
    assert by[1].turns[0].text == "[INST] x" * 50_000 and by[2].turns[0].text == "<|turn|><|image|>" * 3000 and by[2].part_tokens == 3000 * 576
    assert [t.text for t in by[3].turns] == [f"{k}<s>" for k in range(1500)] and by[3].loss_text == "".join(f"{k}<s>" for k in range(1, 1500, 2))


def test_toxicity(docs, none, spark):
    texts = [f"{'what a vile wretch' if k % 3 == 0 else 'what a fine friend'} number {k}" for k in range(120)]
    model = toxicity.fit(texts, [int(k % 3 == 0) for k in range(120)])
    assert model.score("you vile wretch") > 0.7 > 0.3 > model.score("my fine friend")
    rows = toxicity.toxicity_scores(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(none, model).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert 0 <= toxicity.train(docs, labels).score(None) <= 1
    assert toxicity.train(docs, labels.where("false")).score("x") < 0.7


def test_warc(spark, tmp_path):
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (2, None, big), (3, "http://ü", "small"), (4, "u", "small"), (5, "u", None), (None, "u", "no id"), (6, "u", "é" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.archive_pages(df, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[1].payload, by[1].payload_bytes) == ("revisit", 2, None, len(big))
    assert by[2].record_type == by[3].record_type == by[4].record_type == "response" and by[5].payload_bytes == 0
    assert bytes(by[6].payload).decode() == "é" * 70_000
    assert by[3].payload_digest == hashlib.sha1(b"small").hexdigest()
    import gzip
    from pathlib import Path

    for f in Path(tmp_path, "warc").glob("*.warc.gz"):
        data, members = f.read_bytes(), [tuple(map(int, x.split())) for x in Path(f"{f}.idx").read_text().splitlines()]
        assert sum(n for _, n in members) == len(data)
        for at, n in members:
            assert gzip.decompress(data[at : at + n]).startswith(b"WARC/1.1\r\n")
    assert warc.archive_pages(df.where("false"), str(tmp_path / "none")).count() == 0


def test_warc_ids_are_unique_in_archives_of_several_files(spark, tmp_path, monkeypatch):
    """Repeated page ids, many files from one task, and pages that share a payload or nothing."""
    from pathlib import Path

    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = [(k % 30, f"http://a/{k}", ("same " if k % 5 == 0 else f"own {k} ") * 400) for k in range(60)] + [(7, None, None), (7, None, None)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), str(tmp_path)).collect()
    files = list(Path(tmp_path, "warc").glob("*.warc.gz"))
    ids = [h["WARC-Record-ID"] for f in files for h, _ in warc.split_records(warc._inflated(f.open("rb")))]
    assert len(files) > 6 and len(ids) == len(set(ids)) == len(rows) == len(got)
    same = [r for r in got if (r.payload_bytes, r.page_id % 5) == (2000, 0)]
    assert {(r.page_id, r.record_type, r.refers_to) for r in same} == {(k, "revisit", 25) for k in (0, 5, 10, 15, 20)} | {(25, "response", None)}
    assert all(r.record_type == "response" for r in got if r not in same)


def test_split_records_needs_whole_ones():
    data = warc.record(1, "u", b"abc") + warc.record(2, "u", b"", 1, "00" * 20)
    assert [h["WARC-Type"] for h, _ in warc.split_records(iter([data[:9], data[9:200], data[200:]]))] == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([data[:-3]])))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    blob = z.compress(data) + z.flush()
    import io

    assert b"".join(warc._inflated(io.BytesIO(blob + blob))) == data + data


def test_ngram_edges(docs, none):
    rows = ngram_join.ngram_components(docs, words=4, percent=85).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS)
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert by[4].n_shingles == 1 and by[11].n_shingles == 1 and by[None].component_id is None
    assert ngram_join.ngram_components(none).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    start = "all is well with the weather today. " * 600  # 21,600 code points
    rows = [(k, start + ("what a vile wretch " if k % 3 == 0 else "what a fine friend ") * 5 + str(k), int(k % 3 == 0)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model.score("you vile wretch") > 0.7 > 0.3 > model.score("my fine friend")
    same = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    assert (model.which == same.which).all() and abs(model.score(rows[0][1]) - same.score(rows[0][1])) < 1e-6


def test_toxicity_bias_is_that_of_all_labels(spark):
    rows = [(k, ("what a vile wretch" if k % 10 == 0 else "what a fine friend") + f" number {k}", int(k % 10 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), sample_rows=20)
    picked = docs.groupBy("toxic").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("doc_id").alias("h"), "text"))).alias("all")).collect()
    taken = [(x.text, r.toxic) for r in picked for x in r["all"][:20]]
    sampled = toxicity.fit([t for t, _ in taken], [y for _, y in taken])
    assert model.bias - sampled.bias == pytest.approx(np.log((40 / 360) / (20 / 20)), abs=1e-6)


def test_packing_cuts_only_what_fits_nowhere():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = [int(x) for x in np.concatenate((rng.integers(1, 4000, 60), rng.integers(1, 60, 300)))]
        pieces = [p for p in packing.assign(lengths) if p[2] < 4096]
        room, left = {}, dict(enumerate(lengths))
        for _, _, n, s, _ in pieces:
            room[s] = room.get(s, 0) + n
        for d, _, n, s, _ in pieces:
            assert n == left[d] or max(room.values()) < left[d]
            room[s] -= n
            left[d] -= n
