"""A table with keys, written as versions: replace-all loads, chunked inserts, unordered updates and unsets.

A version is a manifest that names its parts: a base, and changes on top of it that are merged when it is read. A manifest is
written under another name and renamed to its number, which fails if that is taken; so a reader sees one whole version,
whatever is written meanwhile, and of two writers from one version one has to try again. Parts are files that never change.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the version."""


class Versions:
    """The table under a path, of a schema with a column `key` whose values are never null."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> int:
        """The number of the last version, 0 where there is none."""
        at = self._path("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> list[dict]:
        if not version:
            return []
        rows = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).collect()
        return json.loads(rows[0].value)

    def _commit(self, version: int, parts: list[dict]) -> int:
        """Makes the version after `version`."""
        held, name = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{version + 1}")
        out = self._fs.create(held, False)
        try:
            out.write(bytearray(json.dumps(parts).encode()))
        finally:
            out.close()
        if self._fs.exists(name) or not self._fs.rename(held, name):
            self._fs.delete(held, False)
            raise Conflict(f"version {version + 1} was made by another writer")
        return version + 1

    def _part(self, df: DataFrame, kind: str, **more) -> dict:
        name = f"parts/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return {"kind": kind, "path": name, "schema": df.schema.jsonValue()} | more

    def _typed(self, df: DataFrame) -> DataFrame:
        """The table's columns, null where the frame has none; rows without a key go."""
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        return df.select(*cols).where(F.col(self.key).isNotNull())

    def replace(self, df: DataFrame) -> int:
        """All rows anew; of rows that share a key the last by all columns stays."""
        at = self.latest()
        rest = [f.name for f in self.schema if f.name != self.key]
        one = self._typed(df).groupBy(self.key).agg(F.max(F.struct(F.lit(0).alias("_"), *rest)).alias("m")).select(self.key, *[f"m.{c}" for c in rest])
        return self._commit(at, [self._part(one.select(*self.schema.names), "base")])

    def insert(self, df: DataFrame, chunk: int = 1000) -> int:
        """Rows whose keys are new, in files of at most `chunk` rows; others are left out."""
        at = self.latest()
        new = self._typed(df).dropDuplicates([self.key]).join(self.read(at).select(self.key), self.key, "left_anti").select(*self.schema.names)
        name = f"parts/insert-{uuid.uuid4().hex}"
        new.write.option("maxRecordsPerFile", chunk).parquet(f"{self.path}/{name}")
        return self._commit(at, [*self._manifest(at), {"kind": "insert", "path": name, "schema": self.schema.jsonValue()}])

    def update(self, df: DataFrame, upsert: bool = False) -> int:
        """Sets the columns that df has beside the key, null too, where the key is there; with `upsert` also adds rows. Of
        rows that share a key the last by all columns counts."""
        at = self.latest()
        names = [c for c in df.columns if c != self.key]
        if unknown := set(names) - set(self.schema.names):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        one = df.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(F.lit(0).alias("_"), *names)).alias("m")).select(self.key, *[F.col(f"m.{c}").cast(self.schema[c].dataType).alias(c) for c in names])
        return self._commit(at, [*self._manifest(at), self._part(one, "upsert" if upsert else "update")])

    def unset(self, keys: DataFrame, *columns: str) -> int:
        """Makes columns null for the keys of a frame."""
        return self.update(keys.select(self.key, *[F.lit(None).cast(self.schema[c].dataType).alias(c) for c in columns]))

    def delete(self, keys: DataFrame) -> int:
        """Takes away the rows of the keys of a frame."""
        at = self.latest()
        return self._commit(at, [*self._manifest(at), self._part(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "delete")])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last one if none is named: one aggregate by key over all its parts, in which of each
        column the last part that has it counts. A deletion ends what came before it."""
        at = self.latest() if version is None else version
        parts = self._manifest(at)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        frames = []
        for n, p in enumerate(parts):
            df = self.spark.read.schema(StructType.fromJson(p["schema"])).parquet(f"{self.path}/{p['path']}")
            # a value and the number of its part; a part that hasn't a column has nothing to say of it
            cells = [(F.struct(F.lit(n).alias("n"), F.col(f.name).cast(f.dataType).alias("v")) if f.name in df.columns else F.lit(None)).cast(f"struct<n:int,v:{f.dataType.simpleString()}>").alias(f.name) for f in self.schema if f.name != self.key]
            kind = p["kind"]
            frames.append(df.select(self.key, F.lit(n if kind in ("base", "insert", "upsert") else None).cast("int").alias("_there"), F.lit(n if kind == "delete" else None).cast("int").alias("_gone"), *cells))
        every = reduce(DataFrame.unionByName, frames)
        rest = [f.name for f in self.schema if f.name != self.key]
        if len(parts) == 1 and parts[0]["kind"] == "base":
            return every.select(*[F.col(f"{c}.v").alias(c) if c in rest else F.col(c) for c in self.schema.names])
        # first what was deleted last; cells of earlier parts than that are void
        gone = every.groupBy(self.key).agg(F.max("_gone").alias("_last")).where("_last is not null")
        if any(p["kind"] == "delete" for p in parts):
            every = every.join(gone, self.key, "left")
            after = lambda n: F.col("_last").isNull() | (n > F.col("_last"))
            every = every.select(self.key, F.when(after(F.col("_there")), F.col("_there")).alias("_there"), *[F.when(after(F.col(c)["n"]), F.col(c)).alias(c) for c in rest])
        # a cell that an update set before its row came to be is none of it
        merged = every.groupBy(self.key).agg(F.min("_there").alias("_there"), *[F.max_by(c, F.col(c)["n"]).alias(c) for c in rest]).where("_there is not null")
        cell = lambda c: F.when(F.col(c)["n"] >= F.col("_there"), F.col(c)["v"])
        return merged.select(*[cell(c).alias(c) if c in rest else F.col(c) for c in self.schema.names])

    def compact(self) -> int:
        """A version of one part with the rows of the last."""
        at = self.latest()
        return self._commit(at, [self._part(self.read(at), "base")])
