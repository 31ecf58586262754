"""Exact duplicates by two passes with a Bloom filter: only rows whose hash may be repeated are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of the filter for each row, and at most: the filter is broadcast, so MAX_BITS bounds what is sent (32 MB).
#: Beyond it more rows count as possibly repeated and are shuffled; the result stays exact.
BITS_PER_ROW, MAX_BITS = 16, 1 << 28


def filter_bits(rows: int, per_row: int = BITS_PER_ROW, most: int = MAX_BITS) -> int:
    """A power of two with about per_row bits for each row, from 2**15 to `most`."""
    return min(most, max(1 << 15, 1 << max(0, rows * per_row - 1).bit_length()))


def repeated_bits(rows: DataFrame, positions: list[str]) -> DataFrame:
    """First pass: the filter as rows (bucket, bitmap), with a bit set where two or more rows have that position."""
    twice = rows.select(F.explode(F.array_distinct(F.array(*positions))).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def has_bit(bitmap: Column, position: Column) -> Column:
    """Whether the bit of a position is set; False where the bitmap is missing."""
    bit = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts form one group. The largest id of a
    group stays. Rows that repeat an id and its text each count in group_size and each carry that id's kept. A group
    of null ids has no keep_id, and all its rows stay. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = filter_bits(docs.count(), most=most_bits)
    # the texts are read once; positions count from 1, as Spark's bitmap functions do
    base = scratch.table(docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), *[(F.pmod(F.xxhash64(text, F.lit(k)), F.lit(bits)) + 1).alias(f"p{k}") for k in (1, 2)]), "hashes")
    bitmaps = scratch.table(repeated_bits(base, ["p1", "p2"]), "bits")
    for k in (1, 2):
        # at most most_bits / 8 bytes, whatever the input
        one = F.broadcast(bitmaps.select(F.col("bucket").alias(f"b{k}"), F.col("bitmap").alias(f"m{k}")))
        base = base.join(one, F.bitmap_bucket_number(f"p{k}") == F.col(f"b{k}"), "left")
    tested = base.select("id", "sha", (has_bit(F.col("m1"), F.col("p1")) & has_bit(F.col("m2"), F.col("p2"))).alias("maybe"))
    # a table, so that both sides of the join are plain shuffles and a hot group's rows can be split by adaptive execution
    groups = scratch.table(tested.where("maybe").groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    some = tested.where("maybe").select("id", "sha").join(groups, "sha", "left").select("id", "sha", "keep_id", "group_size")
    alone = tested.where("not maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return some.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("sha").alias("text_sha256"))
