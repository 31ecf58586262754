"""Joins of names and codes, and resolution of names to known entities in passes from exact to fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bank_key, company_key, let
from .shared import cut
from .similar import candidate_pairs, ratios, scored, similar

# Thresholds of the fuzzy passes in per cent, and the longest abbreviation.
SET_RATIO, SORT_RATIO, GENERIC_SHARE, EXCHANGE_RATIO, ABBREVIATION = 88, 72, 60, 80, 6
#: Thresholds that a search of the best ratio begins with, and how far apart they are; without effect on results.
FIRST_RATIO, RATIO_STEP = 95, 5
# Words that distinguish no company.
GENERIC = (
    "ltd", "limited", "pvt", "private", "llp", "llc", "inc", "incorporated",
    "corp", "corporation", "plc", "ag", "sa", "nv", "bv",
    "india", "indian", "international", "national", "enterprises", "enterprise",
    "industries", "industry", "group", "holdings", "holding", "ventures",
    "venture", "solutions", "solution", "services", "service", "systems",
    "system", "technologies", "technology", "tech", "management",
    "infrastructure", "global", "universal", "united",
    "the", "and", "of", "for", "in", "at", "by",
    "finance", "financial", "capital", "investment", "investments",
    "trading", "traders", "trade", "commercial", "commerce",
    "realty", "realtors", "properties", "property", "developers",
    "associates", "associate", "co", "company",
    "securities", "broking", "brokerage", "wealth",
    "credit", "leasing", "insurance",
    "asset", "assets", "fund", "funds",
)


def full_outer_scores(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two score tables by their upper-cased, trimmed codes; null and repeated codes go first (the least score stays)."""
    def clean(df: DataFrame) -> DataFrame:
        value = next(c for c in df.columns if c != key)
        return df.withColumn(key, F.upper(F.trim(key))).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))

    return clean(left).join(clean(right), key, "full_outer")


def code_ranges(codes: DataFrame, code: str, sections: DataFrame) -> DataFrame:
    """Each code with the section whose range (lo, hi) has its first three characters, compared as texts; sections is a small
    fixed table, its ranges don't overlap."""
    prefix = F.substring(F.col(code), 1, 3)
    return codes.join(F.broadcast(sections), prefix.between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")


def longest_contained(rows: DataFrame, text: str, variants: list[tuple[str, str]]) -> Column:
    """The symbol of the longest variant (name, symbol) that a text contains, of a fixed list: a chain of tests in
    descending length, which needs no join."""
    out = F.lit(None).cast("string")
    for name, symbol in sorted(variants, key=lambda v: (len(v[0]), v[0])):
        out = F.when(F.lower(F.col(text)).contains(name.lower()), F.lit(symbol)).otherwise(out)
    return out


def bank_name_join(a: DataFrame, a_name: str, b: DataFrame, b_name: str) -> DataFrame:
    return a.withColumn("_k", bank_key(F.col(a_name))).join(b.withColumn("_k", bank_key(F.col(b_name))), "_k").drop("_k")


# --- resolution ---------------------------------------------------------------------------------------------------


def distinctive(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(*GENERIC)


def anchor(key: Column) -> Column:
    """The first word of a normalised name that distinguishes it; null where there is none."""
    return F.get(F.filter(F.split(key, "[ -]+"), distinctive), F.lit(0))


def too_generic(a: Column, b: Column) -> Column:
    """Whether two names have common words, and too many of these are generic, or either name has no other words."""
    x, y = F.split(a, " "), F.split(b, " ")
    none = lambda words: ~F.exists(words, distinctive)
    return let(F.array_intersect(x, y), lambda c: (F.size(c) > 0) & (none(x) | none(y) | none(c) | (100 * F.size(F.filter(c, lambda w: ~distinctive(w))) > GENERIC_SHARE * F.size(c))))


def _keyed(known: DataFrame) -> DataFrame:
    """Known names by key; of entities that share one, the last by name has it."""
    return known.select("entity", company_key(F.col("known")).alias("key")).where("key <> ''").groupBy("key").agg(F.max("entity").alias("entity"))


def _scored(asked: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """For asked (raw, key) the `top` known names (key, entity) with the anchor inside: raw, key, other, entity, r, k. They
    meet on that group of three letters of the anchor which fewest known names have."""
    open_ = asked.withColumn("anchor", anchor(F.col("key"))).where("anchor is not null")
    # groups of three letters, and of two for anchors that have no more
    groups = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
    index = known.withColumn("gram", F.explode(F.array_distinct(F.concat(groups("key", 3), groups("key", 2)))))
    of = F.when(F.length("anchor") < 3, F.array("anchor")).otherwise(groups("anchor", 3))
    rare = open_.select("anchor", F.explode(F.array_distinct(of)).alias("gram")).distinct().join(index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rare = rare.groupBy("anchor").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0").select("anchor", "m.gram")
    pairs = open_.join(rare, "anchor").join(index.withColumnRenamed("key", "other"), "gram").where("contains(other, anchor)").select("raw", "key", "other", "entity")
    order = Window.partitionBy("raw").orderBy(F.desc("r.set_ratio"), F.desc("r.sort_ratio"), "entity")
    return pairs.withColumn("r", ratios(F.col("key"), F.col("other"))).withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)


def _best(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For asked (raw, key) the best known name (key, entity) that has the anchor inside and reaches SET_RATIO: raw, key,
    other, entity, set_ratio, sort_ratio."""
    open_ = asked.withColumn("anchor", anchor(F.col("key"))).where("anchor is not null")
    keys = open_.select("key", "anchor").distinct()
    near = candidate_pairs(keys.select(F.col("key").alias("asked")), known.select(F.col("key").alias("known")), SET_RATIO).withColumnsRenamed({"asked": "key", "known": "other"})
    met = near.join(keys, "key").where("contains(other, anchor)").select("key", "other")
    hits = scored(met, "key", "other", SET_RATIO).join(known.withColumnRenamed("key", "other"), "other")
    best = hits.groupBy("key").agg(F.min(F.struct((-F.col("set_ratio")).alias("x"), (-F.col("sort_ratio")).alias("y"), "entity", "other")).alias("m"))
    return open_.select("raw", "key").join(best, "key").select("raw", "key", "m.other", "m.entity", (-F.col("m.x")).alias("set_ratio"), (-F.col("m.y")).alias("sort_ratio"))


def candidates(resolved: DataFrame, name: str, companies: DataFrame, top: int = 3) -> DataFrame:
    """What unresolved names of resolve() might be: (name, rank, known, entity, score), the `top` companies by set_ratio."""
    asked = resolved.where("kind = 'none'").select(F.col(name).alias("raw")).distinct().withColumn("key", company_key(F.col("raw"))).where("key <> ''")
    return _scored(asked, _keyed(companies), top).select(F.col("raw").alias(name), F.col("k").alias("rank"), F.col("other").alias("known"), "entity", F.col("r.set_ratio").alias("score"))


def resolve(names: DataFrame, name: str, banks: DataFrame, companies: DataFrame, trace: bool = False) -> DataFrame:
    """names with entity, kind, passed and confidence; with `trace` also an array of what each pass found, in their order.

    banks and companies are (entity, known). Passes: exact bank, exact company, fuzzy company, abbreviation of a bank. A
    fuzzy candidate has the name's anchor inside it; the best by set_ratio (then sort_ratio, then entity) is tested, and
    fails as a whole if it misses a threshold or shares mostly generic words. Candidates are the pairs of `similar`: what
    does not reach the threshold of set_ratio needn't be scored, since then no candidate of that name does.
    """
    n = names.select(F.col(name).alias("raw")).distinct().withColumn("key", company_key(F.col("raw"))).where("key <> ''")
    known = {"Bank": _keyed(banks), "Company": _keyed(companies)}
    # a bank's name as it stands, but for case, goes before normalised ones
    whole = banks.groupBy(F.lower(F.trim("known")).alias("_low")).agg(F.max("entity").alias("entity")).where("_low <> ''")
    by_name = names.select(F.col(name).alias("raw")).distinct().withColumn("_low", F.lower(F.trim("raw"))).join(whole, "_low").select("raw", "entity")
    told = lambda df, k, p: df.select("raw", "entity", F.lit(k).alias("kind"), F.lit(p).alias("pass"), F.lit(1.0).alias("confidence"))
    by_key = {k: n.join(known[k], "key") for k in known}
    exact = told(by_name, "Bank", 1).unionByName(told(by_key["Bank"].join(by_name.select("raw"), "raw", "left_anti"), "Bank", 1)).unionByName(told(by_key["Company"], "Company", 2))
    best = _best(n.join(exact.select("raw"), "raw", "left_anti"), known["Company"])
    fine = (F.col("sort_ratio") >= SORT_RATIO) & ~too_generic(F.col("key"), F.col("other"))
    fuzzy = best.where(fine).select("raw", "entity", F.lit("Company").alias("kind"), F.lit(3).alias("pass"), (F.col("set_ratio") / 100).alias("confidence"))
    short = n.where((F.length("raw") <= ABBREVIATION) & F.col("raw").rlike("^[A-Z&]+$")).join(banks.select("entity", F.upper("known").alias("raw")), "raw").select("raw", "entity", F.lit("Bank").alias("kind"), F.lit(4).alias("pass"), F.lit(0.9).alias("confidence"))
    every = exact.unionByName(fuzzy).unionByName(short)
    hit = F.struct("pass", "entity", "kind", "confidence")
    one = every.groupBy("raw").agg(F.min(hit).alias("m"), *([F.sort_array(F.collect_set(hit)).alias("_trace")] if trace else []))
    trail = [F.coalesce("_trace", F.array().cast("array<struct<pass:int,entity:string,kind:string,confidence:double>>")).alias("trace")] if trace else []
    return names.join(one, names[name] == F.col("raw"), "left").select(names["*"], "m.entity", F.coalesce("m.kind", F.lit("none")).alias("kind"), F.col("m.pass").alias("passed"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), *trail)


def exchange_key(x: Column) -> Column:
    """A name for comparison with exchange lists: upper case, no bracketed status, legal forms in short."""
    out = F.upper(F.regexp_replace(x, r"-?\([^)]*\)", ""))
    out = F.regexp_replace(out, r"\bPRIVATE\s+LIMITED\b|\bPVT\.?\s*LTD\.?(?!\w)", "PVT LTD")
    out = F.regexp_replace(out, r"\bLIMITED\b|\bLTD\.?(?!\w)", "LTD")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\w\s]", " "), r"\s+", " "))


def _least(hits: DataFrame) -> DataFrame:
    """(_asked, m) of hits (_asked, _ratio, symbol): the best ratio's negative and symbol of each name."""
    return hits.groupBy("_asked").agg(F.min(F.struct((-F.col("_ratio")).alias("less"), "symbol")).alias("m"))


def _best_listed(asked: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """(_asked, m) of asked (_asked) against lists (_known, symbol), by thresholds that fall to `least`."""
    left = cut(asked.select("_asked").distinct(), "asked")
    known, found = lists.select(F.col("_known").alias("known")), None
    for at in [*range(max(FIRST_RATIO, least), least, -RATIO_STEP), least]:
        if left.isEmpty():
            break
        near = similar(left.select(F.col("_asked").alias("asked")), known, at)
        hits = near.join(lists, F.col("known") == F.col("_known")).select(F.col("asked").alias("_asked"), F.col("set_ratio").alias("_ratio"), "symbol")
        best = cut(_least(hits), "best")
        left = cut(left.join(best, "_asked", "left_anti"), "asked")
        found = best if found is None else found.unionByName(best)
    return _least(lists.select(F.col("_known").alias("_asked"), F.lit(0.0).alias("_ratio"), "symbol").limit(0)) if found is None else found


def exchange_match(companies: DataFrame, key: str, names: list[str], listed: DataFrame, least: int = EXCHANGE_RATIO) -> DataFrame:
    """companies with symbol, match and confidence from an exchange list (symbol, known).

    Passes go over the columns `names` in turn, exact first, then fuzzy by set_ratio of `least` or more; the best of a
    pass counts, of equals the least symbol. Fuzzy passes look for the names of the list that reach a high threshold, by
    the signatures of `similar`, and go on to lower ones, down to `least`, with the names that have none yet: what reaches
    a threshold beats all that doesn't, and a high one leaves few pairs to score. A company that no pass matches has the
    match none and confidence 0.
    """
    lists = cut(listed.select("symbol", exchange_key(F.col("known")).alias("_known")).where("_known <> ''").groupBy("_known").agg(F.min("symbol").alias("symbol")), "listed")
    found = None
    for fuzzy in (False, True):
        for n, name in enumerate(names):
            asked = companies.select(F.col(key).alias("_id"), exchange_key(F.col(name)).alias("_asked")).where("_asked <> ''")
            if found is not None:
                asked = asked.join(found.select("_id"), "_id", "left_anti")
            # one row for each name, however many companies have it
            if fuzzy:
                best = _best_listed(asked, lists, least)
            else:
                hits = lists.select(F.col("_known").alias("_asked"), F.lit(100.0).alias("_ratio"), "symbol")
                best = cut(_least(hits), "best")
            best = asked.join(best, "_asked").groupBy("_id").agg(F.min("m").alias("m"))
            label = ("fuzzy" if fuzzy else "exact") + (f"_{name}" if n else "")
            some = best.select("_id", "m.symbol", F.lit(label).alias("match"), F.floor(-F.col("m.less")).cast("int").alias("confidence"))
            found = some if found is None else found.unionByName(some)
    return companies.join(found.withColumnRenamed("_id", key), key, "left").withColumn("match", F.coalesce("match", F.lit("none"))).withColumn("confidence", F.coalesce("confidence", F.lit(0)))
