"""Modes, resume and failures of runs of stages."""

import pytest
from pyspark.sql import functions as F

from tideline.plans.stages import MODES, Run, Stage


def stages(source, log, fail=(), rate=2):
    def make(name, f):
        def run(inputs, **params):
            log.append(name)
            if name in fail:
                raise RuntimeError("no scorer")
            return f(inputs, **params)

        return run

    def scores(inputs, by):
        return inputs["companies"].select("k", (F.col("v") * by).alias("v"))

    return [
        Stage("companies", make("companies", lambda _: source()), sources=(source.path,)),
        Stage("company_stress", make("company_stress", scores), ("companies",), params={"by": rate}),
        Stage("company_news", make("company_news", scores), ("companies",), params={"by": 3}),
        Stage("bank_news", make("bank_news", lambda i: i["company_news"].agg(F.sum("v").alias("v"))), ("company_news",)),
        Stage("sector_stress", make("sector_stress", scores), ("companies",), params={"by": 5}),
    ]


class Source:
    def __init__(self, spark, path, n):
        self.spark, self.path = spark, path
        spark.range(n).select(F.col("id").alias("k"), F.col("id").alias("v")).write.mode("overwrite").parquet(path)

    def __call__(self):
        return self.spark.read.schema("k long, v long").parquet(self.path)


def test_modes_and_resume(spark, tmp_path):
    source, root, log = Source(spark, str(tmp_path / "in"), 10), str(tmp_path / "out"), []
    run = lambda mode, **more: Run(spark, root, stages(source, log, **more)).run(mode)
    assert run("sectors") == {"companies": "done", "sector_stress": "done"} and log == ["companies", "sector_stress"]
    log.clear()
    assert run("all") == {"companies": "there", "company_stress": "done", "company_news": "done", "bank_news": "done"} and log == ["company_stress", "company_news", "bank_news"]
    log.clear()
    sc = spark.sparkContext
    sc.setJobGroup("again", "again")
    again = Run(spark, root, stages(source, log))
    assert set(again.run("all").values()) == {"there"} and set(again.run("bank-news-only").values()) == {"there"} and log == []
    kept = again.read("bank_news")
    assert list(sc.statusTracker().getJobIdsForGroup("again")) == []  # no job was started
    assert kept.first().v == 3 * sum(range(10))
    sc.setJobGroup("", "")
    # another parameter makes what depends on it anew, and nothing else
    assert run("all", rate=7) == {"companies": "there", "company_stress": "done", "company_news": "there", "bank_news": "there"}
    # other files make all anew
    Source(spark, source.path, 12)
    assert set(run("all").values()) == {"done"}
    with pytest.raises(ValueError, match="no such mode"):
        run("odd")
    assert set(MODES) == {"all", "bank-news-only", "sectors"}


def test_failures_stop_what_needs_them(spark, tmp_path):
    source, root, log = Source(spark, str(tmp_path / "in"), 5), str(tmp_path / "out"), []
    got = Run(spark, root, stages(source, log, fail=("company_news",))).run("all")
    assert got == {"companies": "done", "company_stress": "done", "company_news": "failed: RuntimeError: no scorer", "bank_news": "blocked"}
    log.clear()
    assert Run(spark, root, stages(source, log)).run("all") == {"companies": "there", "company_stress": "there", "company_news": "done", "bank_news": "done"}
    # an output without its mark is no output
    r = Run(spark, root, stages(source, log))
    p, fs = r._path(f"{r.output('bank_news')}/_done")
    fs.delete(p, False)
    assert Run(spark, root, stages(source, log)).run("bank-news-only")["bank_news"] == "done"
    with pytest.raises(ValueError, match="need each other"):
        Run(spark, root, [Stage("a", print, ("b",)), Stage("b", print, ("a",))]).order(["a"])
