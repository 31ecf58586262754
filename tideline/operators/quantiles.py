"""Exact quantiles of groups of any size, by counts of ranges: a histogram finds the bucket that a place is in, and the next
one divides that bucket, until it has few rows or one value. No task holds a group, or its distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Buckets of a histogram, and rows of a bucket that are sorted rather than divided.
BUCKETS, SORTED = 1024, 4096
#: Ends of a bucket whose logarithms are further apart than this are divided by the logarithm.
WIDE = 14.0


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """The bucket of a value between two others, which never falls as the value grows: by its sign where that differs, else
    by its share of the way, of the logarithms' way where the ends are far apart."""
    last = F.lit(BUCKETS - 1)

    def share(x: Column) -> Column:
        return F.least(F.floor(x * BUCKETS), last)

    linear = share((v / 2 - lo / 2) / (hi / 2 - lo / 2))  # halves, as the whole way may be beyond a double
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    of_log = share((F.ln(F.abs(v)) - F.ln(small)) / (F.ln(large) - F.ln(small)))
    by_log = F.when(lo > 0, of_log).otherwise(last - of_log)
    out = F.when((lo < 0) & (hi > 0), F.signum(v) + 1).when((small > 0) & (F.ln(large) - F.ln(small) > WIDE), by_log).otherwise(linear)
    return F.when(v == lo, F.lit(0)).when(v == hi, last + 1).otherwise(out).cast("int")


def values_at(rows: DataFrame, group: list[str], value: str, places: DataFrame, few: int = SORTED) -> DataFrame:
    """places (group columns, place, ...) with `at`: the value that has that place, counted from 0, when the values of its
    group that aren't null are sorted. Places beyond the ends have none. Values are compared as doubles; there is at least one group
    column, which may be null. NaN counts as larger than any number."""
    keys = [f"_k{k}" for k in range(len(group))]
    v = cut(rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null"), "values")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    wanted = places.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], "place").distinct()
    ends = v.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    state = wanted.alias("w").join(ends.alias("e"), same("w", "e")).where("w.place between 0 and e.n - 1")
    # `left` is the place among the rows from lo to hi, of which there are n
    state = cut(state.select(*[f"w.{k}" for k in keys], "w.place", F.col("w.place").alias("left"), "e.lo", "e.hi", "e.n"), "state")
    done = []
    while True:
        one = F.col("lo").eqNullSafe(F.col("hi"))
        done.append(state.where(one).select(*keys, "place", F.col("lo").alias("at")))
        # at most `few` rows of a bucket, which are sorted once for all places in it
        small = state.where(~one & (F.col("n") <= few)).groupBy(*keys, "lo", "hi").agg(F.collect_list(F.struct("left", "place")).alias("asked"))
        inside = v.alias("v").join(small.alias("s"), same("v", "s")).where("v.v between s.lo and s.hi").select(*[f"s.{k}" for k in keys], "s.lo", "s.asked", "v.v")
        sorted_ = inside.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("v")) - 1)
        there = sorted_.select(*keys, F.explode(F.filter("asked", lambda a: a["left"] == F.col("r"))).alias("a"), "v")
        done.append(there.select(*keys, "a.place", F.col("v").alias("at")))
        open_ = state.where(~one & (F.col("n") > few))
        if open_.isEmpty():
            break
        inside = v.alias("v").join(open_.alias("s"), same("v", "s")).where("v.v between s.lo and s.hi")
        counted = inside.select(*[f"s.{k}" for k in keys], "s.place", "s.left", "v.v", _bucket(F.col("v.v"), F.col("s.lo"), F.col("s.hi")).alias("bucket"))
        hist = counted.groupBy(*keys, "place", "left", "bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(*keys, "place").orderBy("bucket")  # at most BUCKETS + 1 rows
        run = hist.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        state = cut(run.where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))).select(*keys, "place", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "lo", "hi", "n"), "state")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    on = [F.col(f"p.{g}").eqNullSafe(F.col(f"f.{k}")) for g, k in zip(group, keys, strict=True)] + [F.col("p.place") == F.col("f.place")]
    return places.alias("p").join(found.alias("f"), on, "left").select("p.*", "f.at")


def quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float], floor: bool = False, few: int = SORTED) -> DataFrame:
    """One row per group: its columns, n (how many values aren't null), and a column for each share of `at`, interpolated
    between the two values around it; with `floor` the value at place floor(n * share). Null where n is 0."""
    sizes = cut(rows.groupBy(*group).agg(F.count(value).alias("n")), "sizes")
    shares = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in at.items()]))
    if floor:
        ask = F.array(F.struct(F.least(F.floor(F.col("n") * F.col("s.q")), F.col("n") - 1).alias("place"), F.lit(1.0).alias("weight")))
    else:
        exact = F.col("s.q") * (F.col("n") - 1)
        low = F.floor(exact)
        up = F.when(exact > low, low + 1).otherwise(low)
        ask = F.array(F.struct(low.alias("place"), (1 - (exact - low)).alias("weight")), F.struct(up.alias("place"), F.when(up > low, exact - low).otherwise(0.0).alias("weight")))
    places = sizes.where("n > 0").select(*group, "n", shares.alias("s")).select(*group, F.col("s.name").alias("name"), F.explode(ask).alias("a")).select(*group, "name", F.col("a.place").cast("long").alias("place"), "a.weight")
    # a place that two shares ask for, or one share twice, is looked for once
    found = values_at(rows, group, value, places, few).where("weight > 0").groupBy(*group).pivot("name", list(at)).agg(F.sum(F.col("at") * F.col("weight")))
    on = [F.col(f"z.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    return sizes.alias("z").join(found.alias("f"), on, "left").select("z.*", *[f"f.{name}" for name in at])
