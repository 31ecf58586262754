"""Helpers that the corpus operators share: scratch tables in the shared folder, and vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Base of the polynomial byte hash, odd, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only where none is configured and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{name}{self.n}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch that nothing reads any more."""
        if at := getattr(df, "_scratch", None):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of frames that are gone: its cleaner acts when the driver collects garbage,
        which it may not do for long while executors' disks fill."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], scratch: Scratch, name: str = "pos", total: str = "n") -> DataFrame:
    """The rows with their place (from 0) in the order of their group, and with the rows of that group.

    Rows are dealt to ranges of (group, order) and numbered within them; the rows of a group before a range are a running
    sum over ranges. So a group of any size is spread over tasks, and no window holds more of it than its ranges. Rows
    should be a table, since ranges are sampled first. Rows that tie in all of `order` are numbered as they come."""
    placed = scratch.table(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    ranges = placed.groupBy(*group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[F.col(g).alias(f"__{k}") for k, g in enumerate(group)], "__part", "__first", before.alias("__before"), F.sum("__rows").over(whole).alias("__total"))
    same = part == F.col("__part")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__{k}"))
    place = F.col("__before") + F.col("__at") - F.col("__first")
    return placed.join(ranges, same).select(*rows.columns, place.alias(name), F.col("__total").alias(total))


def trim() -> None:
    """Gives memory that is free back to the system, at the end of a task: a worker goes on to other tasks, and what it
    keeps is lost to the executor it belongs to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), np.uint64(b), np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of bytes other than ASCII white space, A-Z lower-cased."""
    text = text.lower()  # bytes.lower changes A-Z only
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with fewer words, the whole sequence is one."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + w[i : i + n]
    return np.unique(mix(h + np.uint64(k)))


def string_hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes of strings, all at once."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(n)
    starts = ends - n
    power, inverse = _power(len(codes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts] + n.astype(np.uint64))
