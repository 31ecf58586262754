"""The queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, exact_dedup, fingerprints, langid, line_dedup, merkle, ngram_join, packing, token_tree, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document, edits it in two places, and counts again from its tree."""
    return token_tree.count_edited(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.lz_fingerprints(_read(spark, sf_dir, "documents", "doc_id", "text"))


#: A conversation whose texts are control strings of a common template.
CONTROL_ROWS = "(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES {CONTROL_ROWS} AS t(conv_id, turn, role, text)")
    turns = rows.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    read = chat.read_back(chat.format_conversations(turns))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_texts(_read(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(F.col("ids"), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out()))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each checked against the root with its own path; some are tampered with."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = lambda n_chars: merkle.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    claimed = F.when(tampered, leaf(F.col("n_chars") + 1))
    made = merkle.manifest(docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), claimed.alias("claimed")))
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("path"))
    out = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_read(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    known = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs, known))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_packing, op4_lz_fingerprints, op5_chat_format, op6_byte_bpe, op7_toxicity, op8_warc, op9_exact_dedup, op10_ngram_join, op11_merkle_manifest, op12_source_divergence, op13_language_id, pipeline)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ESCAPED = "regexp_replace({}, '" + chat.ESCAPE[0] + r"', '\1\\\2', 'g')"
_MARKS = len(chat.TURN) + len(chat.TEXT) + len(chat.END)

_SIZED = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_SIZED.format(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_SIBLING = "CASE WHEN s.h IS NULL THEN 'N' WHEN (l.pos >> s.level) & 1 = 1 THEN 'B' || s.h ELSE 'A' || s.h END"
_P = "1 + 1000000000::HUGEINT * ({c} + 1) // ({n} + v)"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keep FROM (SELECT DISTINCT doc_id, key FROM keyed WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keep AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_chat_format": f"""
WITH rows AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT t.conv_id, NULL, t.turn, t.role, t.text FROM (VALUES {CONTROL_ROWS.replace("L,", ",")}) t(conv_id, turn, role, text)),
told AS (SELECT *, {_MARKS} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id, alone""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM k""",
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)""",
    "op10_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {_LEAF("n_chars")} AS leaf,
  CASE WHEN ({_CRC32}) % 7 = 0 THEN {_LEAF("(n_chars + 1)")} END AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM docs),
tree AS (SELECT g, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, n, pos // 2),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, n, pos // 2),
tops AS (SELECT DISTINCT level, n FROM upper), depths AS (SELECT DISTINCT g, level, n FROM tree),
steps AS (SELECT l.g, l.pos, s.level, {_SIBLING} AS s FROM leaves l JOIN (SELECT d.g, d.level, t.pos, t.h FROM depths d LEFT JOIN tree t ON t.g = d.g AND t.level = d.level WHERE d.n > 1) s
    ON s.g = l.g AND s.pos = xor(l.pos >> s.level, 1)
  UNION ALL SELECT l.g, l.pos, d.level, 'N' FROM leaves l JOIN depths d ON d.g = l.g AND d.n > 1 WHERE xor(l.pos >> d.level, 1) >= d.n),
above AS (SELECT l.g, s.level, {_SIBLING} AS s FROM subroots l JOIN upper s ON s.n > 1 AND s.pos = xor(l.pos >> s.level, 1)
  UNION ALL SELECT l.g, t.level, 'N' FROM subroots l JOIN tops t ON t.n > 1 WHERE xor(l.pos >> t.level, 1) >= t.n),
paths AS (SELECT g, pos, list(s ORDER BY level) AS path FROM steps GROUP BY g, pos), ends AS (SELECT g, list(s ORDER BY level) AS path FROM above GROUP BY g),
whole AS (SELECT l.*, r.subroot, list_concat(coalesce(p.path, []), coalesce(e.path, [])) AS path, (SELECT h FROM upper WHERE n = 1) AS root
  FROM leaves l JOIN subroots r ON r.g = l.g LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos LEFT JOIN ends e ON e.g = l.g),
folded AS (SELECT *, list_reduce(list_concat([coalesce(claimed, leaf)], path), lambda node, s: CASE s[1] WHEN 'B' THEN sha256(s[2:] || node) WHEN 'A' THEN sha256(node || s[2:]) ELSE sha256(node) END) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
    "op12_source_divergence": rf"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT i, lang, source, unnest(terms) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c_lang FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c_lang) AS n_lang FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
sources AS MATERIALIZED (SELECT DISTINCT lang, source, coalesce(n, 0) AS n FROM docs LEFT JOIN totals USING (lang, source)),
dense AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, {_P.format(c="coalesce(c.c, 0)", n="s.n")} AS p, {_P.format(c="k.c_lang", n="l.n_lang")} AS q
  FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
