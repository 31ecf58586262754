"""Tables in the folder that driver and executors share: they cut a plan, and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process has made and not yet deleted.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local folder is made only where none is set, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(where)
    _made.append(f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were made inside, at its end: results have to be written or collected before it. What a
    result reads can't go while it is lazy, so this is for those who run a query, not for the query."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a frame that several plans read, and returns it read back."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def parts(spark: SparkSession) -> int:
    """As many tasks as there are cores, or shuffle partitions if those are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
