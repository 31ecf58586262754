"""Runs of several stages with modes and resume: the output of a stage is named by what it is made of.

A name is a hash of the stage, its parameters, the files of its sources (path, size and time) and the names of the outputs it
needs. Where a whole output of that name is there, the stage isn't run again: a second run, or one after a failure, goes on
with what is missing, and a change of a parameter or file makes what depends on it anew. A stage that fails stops those that
need it, and no others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Modes, and the stages whose outputs each is run for.
MODES = {"all": ("company_stress", "company_news", "bank_news"), "bank-news-only": ("bank_news",), "sectors": ("sector_stress",)}


@dataclass(frozen=True)
class Stage:
    """make(inputs, **params) gives the output from those of the stages in `needs` by name; sources are folders or files
    that it reads besides. A new `version` of its code makes a new output."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    version: int = 1


class Run:
    """Stages over a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, stages: Iterable[Stage]):
        self.spark, self.root = spark, root.rstrip("/")
        self.stages = {s.name: s for s in stages}
        self._conf, self._jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        self._names: dict[str, str] = {}

    def _path(self, at: str):
        p = self._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self._conf)

    def _files(self, at: str) -> list[tuple[str, int, int]]:
        """(name, size, time) of a file, or of all files of a folder."""
        p, fs = self._path(at)
        if not fs.exists(p):
            raise FileNotFoundError(at)
        out, found = [], fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def output(self, name: str) -> str:
        """The path of a stage's output."""
        if name not in self._names:
            s = self.stages[name]
            made_of = [s.name, s.version, s.params, [self._files(x) for x in s.sources], [self.output(n) for n in s.needs]]
            self._names[name] = f"{self.root}/{name}-{hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
        return self._names[name]

    def is_done(self, name: str) -> bool:
        p, fs = self._path(f"{self.output(name)}/_done")
        return fs.exists(p)

    def read(self, name: str) -> DataFrame:
        """The output of a stage that is done. Its schema is beside it, so that this starts no job."""
        p, fs = self._path(f"{self.output(name)}/_done")
        stream = fs.open(p)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(StructType.fromJson(json.loads(text))).parquet(f"{self.output(name)}/rows")

    def order(self, names: Iterable[str]) -> list[str]:
        """The stages that some need, each behind those it needs."""
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"stages need each other: {' > '.join((*above, name))}")
            if name not in out:
                for n in self.stages[name].needs:
                    visit(n, (*above, name))
                out.append(name)

        for name in names:
            visit(name, ())
        return out

    def run(self, mode: str = "all", modes: dict[str, tuple[str, ...]] = MODES) -> dict[str, str]:
        """What became of each stage of a mode: `there` (done before), `done`, `blocked` (one that it needs failed), or
        `failed: ` and why."""
        if mode not in modes:
            raise ValueError(f"no such mode: {mode}")
        out: dict[str, str] = {}
        for name in self.order(modes[mode]):
            s = self.stages[name]
            if any(out[n] not in ("there", "done") for n in s.needs):
                out[name] = "blocked"
                continue
            try:
                if self.is_done(name):
                    out[name] = "there"
                    continue
                df = s.make({n: self.read(n) for n in s.needs}, **s.params)
                df.write.mode("overwrite").parquet(f"{self.output(name)}/rows")
                p, fs = self._path(f"{self.output(name)}/_done")  # last, so that half an output doesn't count
                stream = fs.create(p, True)
                try:
                    stream.write(bytearray(json.dumps(df.schema.jsonValue()).encode()))
                finally:
                    stream.close()
                out[name] = "done"
            except Exception as e:  # noqa: BLE001  stages fail each for itself, and say why
                out[name] = f"failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        return out
