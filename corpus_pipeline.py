"""A corpus in four stages: toxicity filter, line dedup, near-duplicate filter, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from Parquet. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import line_dedup, ngram_join, packing, toxicity
from tideline.llm.common import Scratch
from tideline.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold. The classifier learns from the labels of this input's documents. Null
    texts are scored as empty ones; rows that share an id, or have none, are scored each for itself. Other columns have any
    name and come back as they are; an empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs, labels), score_col="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat; n_chars is counted anew. Null texts become empty; rows without an
    id are one document, and never the one that keeps a line; columns named n_lines or n_dropped hold those counts, and
    others come back as they are. An empty table gives no rows."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that shares shingles of five words to 0.8 or more; rows without an
    id stay, and so do null, empty and blank texts, which have no shingles. Rows that share an id stay or go together; other
    columns have any name and come back as they are. An empty table gives no rows."""
    groups = ngram_join.ngram_components(docs, words=5, percent=80)
    return ngram_join.without(docs, groups.where("doc_id <> component_id"), "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; null and empty texts are their end alone, and repeated rows are packed
    each for itself. Other columns, whatever their names, are ignored; an empty table gives no rows."""
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
