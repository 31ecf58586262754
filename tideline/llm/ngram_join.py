"""Set similarity join of word shingles by partitioning their universe.

Sets of a size band have one layout: hashing deals shingles to m segments. Two sets with the wanted Jaccard similarity
differ in at most H shingles, so their subsets agree in all but H segments, and each set indexes the hash of its subset
of every segment. A segment is of use where it isn't empty. With more than H of those, a set meets each of its partners
in a subset. How many segments above H + 1 a band has is chosen by expected cost, against that of the sets that miss
this. Those have, among themselves, a second layout of fewer, larger segments, whose subsets they index with their
neighbourhoods of one deletion: a segment then bears one difference. Sets that even so have too few index the shingles
of a prefix. Every pair that meets is verified on whole texts, so links are exact, and none is lost.

Components need no list of all pairs. Subsets that the same sets share are one group. In each group the sets are
compared with its pivot, the one that is in most groups: the middle of a group of copies. What meets and is not yet of
one component is compared next, first the likeliest pair of any two components, then all that are left. Sizes and
sketches are compared before texts are fetched.
"""

from __future__ import annotations

import functools
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, shingle_hashes, trim
from .components import components
from .exact_dedup import filter_bits, has_bit

#: Sets that one group compares with each other; subsets that more share are compared block by block.
BLOCK = 4096
#: Bits of a sketch for each shingle: enough that few pairs pass that aren't linked.
SKETCH = 2
#: Sets that a task remembers, to index copies once; sets of one key that it holds at once; partners of a set that are
#: verified together.
SEEN, HELD, PART = 200_000, 1_000_000, 256
_MASK = np.uint64(0xFF)


@functools.lru_cache(maxsize=None)
def band_of(n: int, percent: int) -> int:
    """The band of a size: the sizes of partners are in the same band or the next."""
    lo, b = 1, 0
    while n > lo * 100 // percent:
        lo, b = lo * 100 // percent + 1, b + 1
    return b


@functools.lru_cache(maxsize=None)
def layout(b: int, percent: int) -> tuple[int, int, int]:
    """(differences H, segments, bits of a sketch) for pairs whose smaller set is in band b."""
    lo = 1
    for _ in range(b):
        lo = lo * 100 // percent + 1
    hi = lo * 100 // percent
    most = hi * (100 - percent) // percent
    if not most:
        return 0, 1, 64

    def expected(spare: int) -> float:
        """Index rows of a set at the band's lower end; sets with too many empty segments index their deletions too."""
        m = most + 1 + spare
        bare = math.exp(-lo / m)
        spread = math.sqrt(max(m * bare * (1 - (1 + lo / m) * bare), 1e-9))
        return m + 0.5 * math.erfc((spare + 0.5 - m * bare) / spread / math.sqrt(2)) * 3 * lo

    spare = min(range(33 + most), key=expected)
    return most, most + 1 + spare, SKETCH * -(-hi // 64) * 64


def _segments(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted hashes: the segment of each, and each segment's size and sum."""
    seg = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    size = np.bincount(seg, minlength=m)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    ends = np.cumsum(size)
    return seg, size, total[ends] - total[ends - size]


def _keys(sums: np.ndarray, segments: np.ndarray, b: int, level: int) -> np.ndarray:
    """The lowest byte of a key is the layout's band."""
    tag = mix(segments.astype(np.uint64) + np.uint64((b << 8 | level) << 40))
    return (mix(sums ^ tag) & ~_MASK) | np.uint64(b & 0xFF)


def index_keys(h: np.ndarray, b: int, percent: int) -> np.ndarray:
    """What a set (sorted hashes) indexes in the layout of band b."""
    most, m, _ = layout(b, percent)
    _, size, sums = _segments(h, m)
    full = np.flatnonzero(size)
    out = [_keys(sums[full], full, b, 0)]
    if len(full) <= most:
        m = max(1, most // 2 + 1)
        seg, size, sums = _segments(h, m)
        full = np.flatnonzero(size)
        some = size[seg] > 1
        out += [_keys(sums[full], full, b, 1), _keys(sums[seg[some]] - h[some], seg[some], b, 1)]
        if np.minimum(size, 2).sum() <= most:
            out.append(_keys(h[: len(h) - -(-len(h) * percent // 100) + 1], np.zeros(1, np.int64), b, 2))
    return np.concatenate(out)


def sketch(h: np.ndarray, b: int, percent: int) -> bytes:
    """The parities of how many shingles hash to each bit. Two sets differ in at least as many shingles as bits."""
    bits = layout(b, percent)[2]
    at = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()


def set_id(h: np.ndarray) -> int:
    return int(mix(np.array([h.sum(dtype=np.uint64) ^ np.uint64(len(h))])).view(np.int64)[0])


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of batches, with one text a time as a Python string."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in columns), strict=True):
            yield tuple(x.as_py() for x in row)


#: Rows, or bytes of keys and sketches, that a task hands on at once.
OUT_ROWS, OUT_BYTES = 2000, 8_000_000
_SETS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("band", pa.int32()), ("own", pa.binary()), ("lower", pa.binary())])
SETS = "id long, text_hash long, n long, sid long, band int, own binary, lower binary"


def _sets(words: int, percent: int):
    """The set of each text: its size, number and band, and its sketches in the layouts of that band and the one below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for doc_id, text_hash, text in _rows(batches, "id", "text_hash", "text"):
            h = shingle_hashes(text, words)
            if len(h):
                b = band_of(len(h), percent)
                out.append((doc_id, text_hash, len(h), set_id(h), b, sketch(h, b, percent), sketch(h, b - 1, percent) if b else None))
                held += len(out[-1][5])
            else:
                out.append((doc_id, text_hash, 0, None, None, None, None))
            if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SETS, strict=True)], schema=_SETS)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SETS, strict=True)], schema=_SETS)
        trim()

    return run


def _index(words: int, percent: int):
    """(key, sid): what the sets of the texts index, once for each set that the task remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        keys, sids, held = [], [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), [len(k) for k in keys]))], names=["key", "sid"])

        for (text,) in _rows(batches, "text"):
            h = shingle_hashes(text, words)
            if not len(h) or (sid := set_id(h)) in seen:  # a copy of a set indexed by this task has nothing to add
                continue
            seen[sid] = None
            if len(seen) > SEEN:
                seen.popitem(last=False)
            b = band_of(len(h), percent)
            for x in [b, b - 1] if b else [b]:
                keys.append(index_keys(h, x, percent))
                sids.append(sid)
                held += 8 * len(keys[-1])
            if held >= OUT_BYTES:
                yield told()
                keys, sids, held = [], [], 0
        if keys:
            yield told()
        trim()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and set, (group, sid) for the keys that several sets share. A group's number is a hash of
    its sets and of the layout's band, so that keys with the same sets give the same rows; groups of more than HELD
    sets go by their key."""
    key, sid, told = np.empty(0, np.int64), np.empty(0, np.int64), None

    def rows(k: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(s)], names=["key", "sid"])

    def grouped(key: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(starts, len(key)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sid.view(np.uint64)), dtype=np.uint64)))
        sums = mix(total[starts + n] - total[starts] + n.astype(np.uint64))
        name = (sums & ~_MASK) | (key[starts].view(np.uint64) & _MASK)
        shared = np.repeat(n > 1, n)
        if shared.any():
            yield rows(np.repeat(name, n)[shared].view(np.int64), sid[shared])

    for b in batches:
        k, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid"))
        key, sid = np.concatenate((key, k)), np.concatenate((sid, s))
        if not len(key):
            continue
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
        key, sid = key[new], sid[new]
        if told is not None:  # the key whose rows are passed on as they come; the first row here is its last one there
            end = int(np.searchsorted(key, told, "right"))
            if end > 1:
                yield rows(key[1:end], sid[1:end])
            if end == len(key):
                key, sid = key[-1:], sid[-1:]
                continue
            key, sid, told = key[end:], sid[end:], None
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield from grouped(key[:last], sid[:last])
            key, sid = key[last:], sid[last:]
        if len(key) > HELD:
            yield rows(key, sid)
            key, sid, told = key[-1:], sid[-1:], key[-1]
    if len(key) > 1:
        yield from grouped(key, sid)


def _likely(percent: int):
    """Of rows (a, b, n_a, n_b, x, y), the pairs whose sketches x and y allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                differ = int(np.bitwise_count(np.frombuffer(x.as_buffer(), np.uint64) ^ np.frombuffer(y.as_buffer(), np.uint64)).sum())
                keep.append(differ * (100 + percent) <= (100 - percent) * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cross(percent: int, best: bool):
    """From rows sorted by key, lo, hi: pairs of different components whose sizes and sketches allow a link; with best,
    the one of any two components of a key whose sketches differ least."""

    def pairs(rows: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sid, comp, block, n = (np.array([r[c] for r in rows], np.int64) for c in ("sid", "comp", "block", "n"))
        bits = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint64).reshape(len(rows), -1)
        apart = rows[0]["lo"] != rows[0]["hi"]
        top: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in range(len(rows) - 1):
            rest = slice(k + 1, None)
            ok = (comp[rest] != comp[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
            if apart:
                ok &= block[rest] != block[k]
            at = k + 1 + np.flatnonzero(ok)
            if not len(at):
                continue
            differ = np.bitwise_count(bits[at] ^ bits[k]).sum(1).astype(np.int64)
            near = differ * (100 + percent) <= (100 - percent) * (n[at] + n[k])
            at, differ = at[near], differ[near]
            if best:
                for d, x in zip(differ.tolist(), at.tolist(), strict=True):
                    of = (min(comp[k], comp[x]), max(comp[k], comp[x]))
                    if of not in top or d < top[of][0]:
                        top[of] = (d, sid[k], sid[x])
            elif len(at):
                yield np.minimum(sid[at], sid[k]), np.maximum(sid[at], sid[k])
        if top:
            ends = np.array([x[1:] for x in top.values()], np.int64)
            yield ends.min(1), ends.max(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(pairs(held)) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for r in b.to_pylist():
                if (r["key"], r["lo"], r["hi"]) != of:
                    yield from flush()
                    held, of = [], (r["key"], r["lo"], r["hi"])
                held.append(r)
        yield from flush()

    return run


def _verified(words: int, percent: int):
    """From rows (a, part, b, text) sorted by a, part and whether b is a, which puts the text of a first: the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, p, out = None, None, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for a, part, b, text in _rows(batches, "a", "part", "b", "text"):
            q = shingle_hashes(text, words)
            if a == b:
                of, p = (a, part), q
                continue
            if of != (a, part):
                raise ValueError("a pair came without its first text")
            both = np.concatenate((p, q))
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= percent * (len(p) + len(q) - inter):
                out.append((a, b))
                if len(out) == OUT_ROWS:
                    yield told()
                    out = []
        yield told()

    return run


def bitmap_of(rows: DataFrame, column: str, count: int) -> tuple[DataFrame, int]:
    """A filter of bounded size: the bits of the hashes of a column, as rows (bucket, bitmap), and their number."""
    bits = filter_bits(count)
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    return rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")), bits


def in_bitmap(rows: DataFrame, column: str, bitmap: DataFrame, bits: int, inside: bool = True) -> DataFrame:
    """The rows whose value may be in the filter, of at most 32 MB, which is broadcast; or those whose value is not."""
    one = F.broadcast(bitmap.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))
    found = rows.withColumn("__at", F.pmod(F.xxhash64(column), F.lit(bits)) + 1).join(one, F.bitmap_bucket_number("__at") == F.col("__bucket"), "inner" if inside else "left")
    hit = has_bit(F.col("__bitmap"), F.col("__at"))
    return found.where(hit if inside else ~hit).select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows whose value is not in `gone` (column). Only rows that a filter of bounded size may have are shuffled."""
    scratch = Scratch(rows.sparkSession, "without")
    gone = scratch.table(gone.select(column).distinct(), "gone")
    bitmap, bits = bitmap_of(gone, column, gone.count())
    bitmap = scratch.table(bitmap, "bits")
    maybe = in_bitmap(rows, column, bitmap, bits).join(gone, column, "left_anti").select(*rows.columns)
    return in_bitmap(rows, column, bitmap, bits, inside=False).unionByName(maybe)


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach, its own included).

    A text's words are its runs of other than ASCII white space, A-Z lower-cased; its set has their distinct shingles of
    `words` words, or, with fewer words, the whole sequence. Two documents link when 100 * intersection >= percent *
    union. Null, empty and blank texts have an empty set and link with nothing. Shingles and whole sets count as equal
    when their 64-bit hashes are. Repeated rows come back repeated; a null id is never the least, and is the component
    of documents only where no other id is. Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    every = scratch.table(base.mapInArrow(_sets(words, percent), SETS), "every")
    full = every.where("n > 0")
    # the index is shuffled once, from the texts, and kept nowhere: most of its keys are those of one set
    index = base.select("text").mapInArrow(_index(words, percent), "key long, sid long")
    met = scratch.table(index.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_met, "key long, sid long").distinct(), "met")
    scratch.release()
    # of each set that meets another, the least document and the sketches
    some = scratch.table(met.select("sid").distinct(), "some")
    bitmap, bits = bitmap_of(some, "sid", some.count())
    found = in_bitmap(full, "sid", scratch.table(bitmap, "bits"), bits).join(some, "sid", "left_semi")
    nodes = scratch.table(found.groupBy("sid").agg(F.min(F.struct("id", "text_hash", "n", "band", "own", "lower")).alias("of")).select("sid", "of.*"), "nodes")

    no_id = F.lit(-(1 << 63))  # stands for null beside a text's hash

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs of sets, those that are linked, by sizes, then sketches, then texts. The text of a comes once for each
        PART of its partners, that of b once for each pair."""
        one = lambda c: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("band").alias(f"band_{c}"), F.col("own").alias(f"own_{c}"), F.col("lower").alias(f"lower_{c}"))
        fit = pairs.join(one("a"), "a").join(one("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and abs(band_a - band_b) <= 1")
        in_layout = lambda c, d: F.when(F.col(f"band_{c}") <= F.col(f"band_{d}"), F.col(f"own_{c}")).otherwise(F.col(f"lower_{c}"))
        likely = scratch.table(fit.select("a", "b", "n_a", "n_b", in_layout("a", "b").alias("x"), in_layout("b", "a").alias("y")).mapInArrow(_likely(percent), "a long, b long"), "likely")
        parts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        tails = likely.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
        heads = tails.select("a", "part", F.col("a").alias("b")).distinct()
        wanted = scratch.table(tails.unionByName(heads).join(nodes.select(F.col("sid").alias("b"), F.coalesce("id", no_id).alias("id"), "text_hash"), "b"), "wanted")
        bitmap, bits = bitmap_of(wanted, "id", likely.count())
        texts = in_bitmap(base.withColumn("id", F.coalesce("id", no_id)), "id", scratch.table(bitmap, "bits"), bits).dropDuplicates(["id", "text_hash"])
        rows = wanted.join(texts, ["id", "text_hash"]).select("a", "part", "b", "text")
        return scratch.table(rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a")).mapInArrow(_verified(words, percent), "a long, b long").distinct(), "links")

    # the pivot of a group: of its sets the one that is in most groups
    reach = met.groupBy("sid").agg(F.count(F.lit(1)).alias("reach"))
    pivots = scratch.table(met.join(reach, "sid").groupBy("key").agg(F.max(F.struct("reach", "sid")).alias("top")).select("key", F.col("top.sid").alias("a")), "pivots")
    rest = scratch.table(met.join(pivots, "key").where("sid <> a").select("key", "sid", "a"), "rest")
    label = components(links(rest.select("a", F.col("sid").alias("b")).distinct()), scratch)
    scratch.drop(pivots)
    scratch.release()

    def crossed(best: bool) -> DataFrame | None:
        """Pairs in groups where different components still meet. Those with the pivot have been compared."""
        labelled = scratch.table(rest.select("key", "sid").join(label.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("label", "sid").alias("comp")), "labelled")
        open_ = scratch.table(labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("g")).where("x <> y").select("key", F.ceil(F.col("g") / block).cast("int").alias("blocks")), "open")
        if open_.isEmpty():
            return None
        dealt = (
            labelled.join(open_, "key")
            .withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .join(nodes.select("sid", "n", "band", "own", "lower"), "sid")
            .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid", "comp", "n", F.when(F.col("key").bitwiseAND(0xFF) == F.col("band").bitwiseAND(0xFF), F.col("own")).otherwise(F.col("lower")).alias("sketch"))
        )
        out = scratch.table(dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_cross(percent, best), "a long, b long").distinct(), "crossed")
        for done in (labelled, open_):
            scratch.drop(done)
        return None if out.isEmpty() else out

    for best in (True, False):
        pairs = crossed(best)
        if pairs is None:
            break
        ends = links(pairs)
        if ends.isEmpty():
            continue
        for c in ("a", "b"):
            ends = ends.join(label.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")), c, "left").withColumn(c, F.coalesce(f"l_{c}", c)).drop(f"l_{c}")
        merged = components(ends, scratch)
        # labels of labels, and nodes that had none
        old = label.select("node", F.col("label").alias("was")).join(merged.select(F.col("node").alias("was"), "label"), "was", "left").select("node", F.coalesce("label", "was").alias("label"))
        label = scratch.table(old.unionByName(merged.join(label.select("node"), "node", "left_anti")), "label")
        scratch.release()
    final = (
        full.groupBy("sid").agg(F.min("id").alias("rep"))
        .join(label.withColumnRenamed("node", "sid"), "sid", "left")
        .select("sid", "rep", F.coalesce("label", "sid").alias("comp"))
    )
    least = final.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_set = scratch.table(final.join(least, "comp").select("sid", "component_id"), "of_set")
    linked = full.select("id", "n", "sid").join(of_set, "sid", "left").select("id", "n", "component_id")
    alone = every.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
