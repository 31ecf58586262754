"""How the words of one source differ from those of others, and of the whole language: an audit of sources.

Shares of terms are whole numbers of SCALE, smoothed by one. The divergence of two sources is a sum over all kept terms,
most of which neither has: so it is the value of a term that neither has, times all terms, plus corrections for the terms
that one has, which depend on its count only and go by a histogram of counts, plus corrections for the terms that both
have. Terms are ranked by radix selection: histograms over the bits of the values find the threshold of each group.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, trim

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Counts that a task holds, and bytes of a text that are split at once.
HELD, PIECE = 300_000, 4_000_000
#: Rows of a group that the selection leaves to a sort, and significant bits of each of its histograms.
SORTED, DIGIT = 4096, 10
#: A-Z lower-cased; every byte that is not a letter of ASCII or a part of another code point becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    b = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(b):
        end = b.find(b" ", at + PIECE)
        end = len(b) if end < 0 else end
        yield b[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term in a task's rows, and a row without a term
    for each group that occurs."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            m = len(n) + 1
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, m), pa.repeat(source, m), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], schema=_COUNTS)

    held = 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            lang, source, text = (x.as_py() for x in row)
            n, docs = seen[lang, source]
            held -= len(n)
            own: set[bytes] = set()
            for terms in terms_of(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n)
            if held >= HELD:
                yield from told()
                seen.clear()
                held = 0
    yield from told()
    trim()


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in decimals; null where there are no terms."""
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0)) div nullif(cast({total} + {terms} as decimal(20, 0)), 0)")


def _apart(p: str, q: str) -> str:
    """floor((p - q) ** 2 / q); shares are at most SCALE + 1, so squares are below 2 ** 60."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def top_terms(rows: DataFrame, group: list[str], value: str, item: str, k: int, scratch: Scratch, sorted_rows: int = SORTED) -> DataFrame:
    """The k rows of each group with the largest values, ties by the items' bytes, and their rank from 1.

    Values are whole, 0 or more. Each round counts the values of a group by their next bits (the first round by their
    length and first bits) and finds the bucket of the k-th; the next round looks into that bucket only. When all bits are
    used, prefixes of the items are counted in the same way, of twice the length each round. A group is ready when the
    rows down to its bucket are few enough to sort."""
    bits = F.length(F.bin(value))
    down = Window.partitionBy(*group)
    on = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]

    def bucket(counted: DataFrame, *order: Column) -> DataFrame:
        """The first bucket, in order, at whose end k rows are reached, or else the last."""
        w = down.orderBy(*order)
        run = counted.withColumn("upto", F.col("above") + F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return run.withColumn("first", F.row_number().over(w)).withColumn("last", F.max("first").over(down)).withColumn("at", F.min(F.when(F.col("upto") >= k, F.col("first"))).over(down)).where("first = coalesce(at, last)")

    shift = F.greatest(bits - DIGIT, F.lit(0))
    first = rows.select(*group, shift.alias("shift"), F.expr(f"shiftright({value}, greatest(length(bin({value})) - {DIGIT}, 0))").alias("prefix"))
    hist = first.groupBy(*group, "shift", "prefix").agg(F.count(F.lit(1)).alias("rows")).withColumn("above", F.lit(0).cast("long"))
    found = bucket(hist, F.col("shift").desc(), F.col("prefix").desc())
    state = scratch.table(found.select(*group, "shift", "prefix", (F.col("upto") - F.col("rows")).alias("above"), "upto"), "state")
    ready = [state.where(F.col("upto") <= sorted_rows).selectExpr(*group, "shiftleft(prefix, shift) AS floor", "cast(null as binary) AS stop")]
    while not (open_ := state.where((F.col("upto") > sorted_rows) & (F.col("shift") > 0))).isEmpty():
        inside = rows.alias("r").join(open_.alias("s"), on("r", "s")).where(F.expr(f"shiftright(r.{value}, s.shift) = s.prefix"))
        finer = inside.selectExpr(*[f"r.{g}" for g in group], f"greatest(s.shift - {DIGIT}, 0) AS shift", f"shiftright(r.{value}, greatest(s.shift - {DIGIT}, 0)) AS prefix", "s.above")
        found = bucket(finer.groupBy(*group, "shift", "prefix", "above").agg(F.count(F.lit(1)).alias("rows")), F.col("prefix").desc())
        more = state.where((F.col("upto") > sorted_rows) & (F.col("shift") == 0))
        state = scratch.table(found.select(*group, "shift", "prefix", (F.col("upto") - F.col("rows")).alias("above"), "upto").unionByName(more), "state")
        ready.append(state.where(F.col("upto") <= sorted_rows).selectExpr(*group, "shiftleft(prefix, shift) AS floor", "cast(null as binary) AS stop"))
    # what is open now has too many rows of one value
    ties = scratch.table(state.where(F.col("upto") > sorted_rows).select(*group, F.col("prefix").alias("floor"), "above", "upto", F.lit(b"").alias("stop")), "ties")
    length = 4
    while not ties.isEmpty():
        inside = rows.alias("r").join(ties.alias("s"), on("r", "s")).where(F.expr(f"r.{value} = s.floor and substring(cast(r.{item} as binary), 1, {0 if length == 4 else length // 2}) = s.stop"))
        finer = inside.selectExpr(*[f"r.{g}" for g in group], "s.floor", "s.above", f"substring(cast(r.{item} as binary), 1, {length}) AS stop", f"octet_length(r.{item}) > {length} AS longer")
        found = bucket(finer.groupBy(*group, "floor", "above", "stop").agg(F.count(F.lit(1)).alias("rows"), F.max("longer").alias("longer")), F.col("stop").asc())
        told = scratch.table(found.select(*group, "floor", (F.col("upto") - F.col("rows")).alias("above"), "upto", "stop", "longer"), "ties")
        # items that are the same to their end can't be told apart: then all of them are sorted
        done = (F.col("upto") <= sorted_rows) | ~F.col("longer")
        ready.append(told.where(done).select(*group, "floor", "stop"))
        ties = told.where(~done)
        length *= 2
    bounds = ready[0]
    for r in ready[1:]:
        bounds = bounds.unionByName(r)
    bounds = scratch.table(bounds, "bounds")
    inside = F.expr(f"r.{value} > b.floor or r.{value} = b.floor and (b.stop is null or substring(cast(r.{item} as binary), 1, octet_length(b.stop)) <= b.stop)")
    some = rows.alias("r").join(bounds.alias("b"), on("r", "b")).where(inside).select("r.*")
    rank = F.row_number().over(down.orderBy(F.col(value).desc(), F.col(item).asc()))
    return some.withColumn("rank", rank).where(F.col("rank") <= k)


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, sorted_rows: int = SORTED) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, every other source by the sum of the
    divergences of all terms (part `pair`), and the `top` terms by which it most exceeds the language (part `term`).

    Null languages, sources and texts count as empty ones. Terms are runs of ASCII letters, A-Z lower-cased, and of code
    points from U+0080; a language keeps those in at least min_docs of its rows, each row being a document, repeated ones
    too. Sources without terms take part in pairs. A language with one source has no pairs; one without kept terms has
    pairs of value 0 and no terms. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = scratch.table(texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    vocabulary = scratch.table(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
    kept = scratch.table(counts.where("term is not null").select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept")
    of_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = counts.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "v", "total_lang"])
    sources = scratch.table(sources.withColumn("p0", _share("0", "total", "v")), "sources")
    shares = scratch.table(kept.join(sources, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "total", "v").alias("p"), "p0", _share("n_lang", "total_lang", "v").alias("q")), "shares")

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    terms = top_terms(above, ["lang", "source"], "value", "item", top, scratch, sorted_rows)

    # each ordered pair once, with what it would be if neither source had any term
    other = sources.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    none = sources.join(other, "lang").where("source <> item").selectExpr("lang", "source", "item", f"coalesce(v * {_apart('p0', 'q0')}, 0) AS value")
    # the terms of a source against any other that lacks them, by its histogram of counts
    hist = scratch.table(shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k")), "hist")
    one = hist.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"k * ({_apart('p', 'q0')} - {_apart('p0', 'q0')})")).alias("out"), F.sum(F.expr(f"k * ({_apart('q0', 'p')} - {_apart('q0', 'p0')})")).alias("back")
    )
    one = scratch.table(one, "one")
    # the terms that two sources have: what the two corrections above make of them is taken back
    x = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    y = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    both = lambda p, q, p0, q0: F.sum(F.expr(f"{_apart(p, q)} - {_apart(p, q0)} - {_apart(p0, q)} + {_apart(p0, q0)}"))
    two = scratch.table(x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(both("pa", "pb", "za", "zb").alias("out"), both("pb", "pa", "zb", "za").alias("back")), "two")
    parts = [none, one.selectExpr("lang", "source", "item", "out AS value"), one.selectExpr("lang", "item AS source", "source AS item", "back AS value"), two.selectExpr("lang", "a AS source", "b AS item", "out AS value"), two.selectExpr("lang", "b AS source", "a AS item", "back AS value")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pairs = scratch.table(every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    pairs = numbered(pairs, ["lang", "source"], [F.col("value").desc(), F.col("item")], scratch).withColumn("rank", F.col("pos") + 1)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(terms, "term"))
