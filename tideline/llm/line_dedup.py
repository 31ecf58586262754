"""Line dedup: lines that many documents repeat go from all of them but one. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The white space [\x20\x09-\x0D] that is stripped at both ends of a line.
BLANK = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS = 40, 5


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text: stripped, A-Z lower-cased."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lower, "\n"), lambda x: F.trim(x, F.lit(BLANK)))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, drops): for each text that loses lines, their positions."""
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # what is computed once a text comes before its lines are exploded
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), line_keys(text).alias("keys")).select("id", "text_hash", F.posexplode("keys").alias("pos", "key"))
    lines = scratch.table(every.where(F.char_length("key") >= min_chars).select("id", "text_hash", "pos", _hash(F.col("key")).alias("line")), "lines")
    seen = lines.select("line", "id").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    # a table, so that adaptive execution can split the rows of a line that a third of all documents hold
    common = scratch.table(seen.where(F.col("n") >= min_docs).select("line", "keep"), "common")
    return lines.join(common, "line").where("id is null or id <> keep").groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with all their columns, `text_col` without the repeated lines, and n_lines and n_dropped.

    A text is split at line feeds; a null or empty text is one empty line and comes back empty. A line whose key has
    min_chars code points or more and is found in min_docs documents or more is dropped from every document but that
    with the largest id. Rows that share an id are one document; where they share the largest, all of them keep the line.
    Rows without an id are one document too, and never the largest. Columns that clash with n_lines or n_dropped are
    replaced. The cost of a text is in proportion to its lines. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("drops").alias("__drops"))
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    # the lines and the positions of those that stay are columns of their own, so that each is computed once a row
    out = joined.withColumn("__lines", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drops")  # by a hash set; in order
    out = out.withColumn("__stay", F.when(F.col("__drops").isNotNull(), stay))
    kept = F.when(F.col("__stay").isNull(), text).otherwise(F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n"))
    new = {text_col: kept, "n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__lines") - F.size("__stay"), F.lit(0)).cast("long")}
    rest = [F.col(c) for c in docs.columns if c not in new]
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return out.select(*rest, *[v.alias(k) for k, v in new.items()]).select(*order)
