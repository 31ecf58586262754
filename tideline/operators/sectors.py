"""Scores of sectors: replies of a scorer, their spread over industries, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp

# The score of a reply that can't be read, and the ends of scores of a dry run.
UNREAD, DRY_LOW, DRY_HIGH = 0.5, 0.1, 0.9


def score_reply(reply: Column) -> Column:
    """struct(score, reasoning) of a scorer's reply, JSON with stress_score and reasoning, also in a fenced block. Scores
    are cut to 0 to 1 and rounded to 4 places; one that is missing or no number, or a reply that isn't JSON, is UNREAD."""
    plain = F.trim(F.regexp_replace(reply, "```(?:json)?", ""))
    score = F.get_json_object(plain, "$.stress_score").try_cast("double")
    read = F.get_json_object(plain, "$").isNotNull()
    return F.struct(F.round(F.coalesce(clamp(score), F.lit(UNREAD)), 4).alias("score"), F.when(read, F.coalesce(F.get_json_object(plain, "$.reasoning"), F.lit(""))).otherwise("Parse error").alias("reasoning"))


def dry_score(sector: Column) -> Column:
    """A score from 0.1 to 0.9 that depends on the name only, for runs without a scorer."""
    part = F.conv(F.substring(F.md5(sector.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    return F.round(DRY_LOW + (DRY_HIGH - DRY_LOW) * part, 4)


def spread(taxonomy: DataFrame, scores: DataFrame) -> DataFrame:
    """taxonomy (industry, macro) with all columns of scores (macro, ...), null where a macro sector has none, and one row
    for industries without a name."""
    rows = taxonomy.select("industry", "macro").join(scores, "macro", "left").select("industry", *scores.columns)
    none = taxonomy.sparkSession.createDataFrame([("", "Unclassified")], "industry string, macro string")
    return rows.unionByName(none, allowMissingColumns=True)


def of_industry(companies: DataFrame, taxonomy: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """companies (industry, ...) with the score of their industry's macro sector."""
    by_industry = taxonomy.select("industry", "macro").join(scores.select("macro", score), "macro", "left").select("industry", "macro", score)
    return companies.join(by_industry, "industry", "left")


def top_sectors(rows: DataFrame, score: str, k: int) -> DataFrame:
    """The k macro sectors of the highest scores: (macro, industry, score), with the first industry of each by name."""
    one = rows.where(F.col(score).isNotNull()).groupBy("macro").agg(F.min_by(F.struct("industry", score), F.struct(-F.col(score), F.col("industry"))).alias("m"))
    return one.select("macro", "m.*").orderBy(F.desc(score), "macro").limit(k)


def by_section(rows: DataFrame, section: str, value: str) -> DataFrame:
    """Counts and sums by section, with the share of all, and rows without a section as one of their own."""
    sums = rows.groupBy(F.coalesce(section, F.lit("Unmapped")).alias("section")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


def categorize(facilities: DataFrame, mapping: DataFrame) -> DataFrame:
    """facilities (facility, ...) with the bucket that a mapping (category, name, rank) has for just that name, of several
    the first category's by rank; Uncategorized where it has none."""
    one = mapping.groupBy(F.col("name").alias("facility")).agg(F.min_by("category", F.struct("rank", "category")).alias("_bucket"))
    return facilities.join(one, "facility", "left").withColumn("bucket", F.coalesce("_bucket", F.lit("Uncategorized"))).drop("_bucket")


def by_bucket(facilities: DataFrame) -> DataFrame:
    """facilities (bank, bucket, facility, amount): sums of each bank and bucket, and a map of those of its facilities.
    A bucket that is null is Uncategorized."""
    inner = facilities.groupBy("bank", F.coalesce("bucket", F.lit("Uncategorized")).alias("bucket"), "facility").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return inner.groupBy("bank", "bucket").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("facility", "amount")))).alias("facilities"))


def coverage(df: DataFrame, **tests: Column) -> DataFrame:
    """One row: how many rows there are, and how many pass each test."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(name) for name, t in tests.items()])


def unmatched(companies: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """(source, key) for each company that a source does not have."""
    out = None
    for name, df in sources.items():
        part = companies.join(df.select(key), key, "left_anti").select(F.lit(name).alias("source"), key)
        out = part if out is None else out.unionByName(part)
    return out


def markdown(df: DataFrame, title: str, most: int = 100) -> str:
    """A report of the first `most` rows, in the order of all columns."""
    rows = df.orderBy(*df.columns).limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), "|" + "-|" * len(df.columns), *map(line, rows)]) + "\n"
