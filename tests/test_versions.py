"""Versioned tables against a dict, readers during writes, and writers that meet."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.sources.versions import Conflict, Versions

SCHEMA = "k string, a int, b string"


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "a", "b").collect())


def test_same_as_a_dict(spark, tmp_path):
    draw = random.Random(2)
    table, want = Versions(spark, str(tmp_path / "t"), SCHEMA, "k"), {}
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    assert table.latest() == 0 and rows(table.read()) == []
    seen = []
    for step, do in enumerate(["insert", "update", "unset", "upsert", "delete", "insert", "update", "replace", "delete", "upsert", "compact", "update"]):
        keys = draw.sample([f"k{x}" for x in range(14)], 7)
        if do == "insert":
            table.insert(frame([*[(k, step, f"i{step}") for k in keys], (None, 1, "x")], SCHEMA))
            want |= {k: (step, f"i{step}") for k in keys if k not in want}
        elif do == "update":
            table.update(frame([(k, step) for k in keys], "k string, a int"))
            want |= {k: (step, want[k][1]) for k in keys if k in want}
        elif do == "upsert":
            table.update(frame([(k, f"u{step}") for k in keys], "k string, b string"), upsert=True)
            want |= {k: (want[k][0] if k in want else None, f"u{step}") for k in keys}
        elif do == "unset":
            table.unset(frame([(k,) for k in keys], "k string"), "b")
            want |= {k: (want[k][0], None) for k in keys if k in want}
        elif do == "delete":
            table.delete(frame([(k,) for k in keys], "k string"))
            want = {k: v for k, v in want.items() if k not in keys}
        elif do == "replace":
            table.replace(frame([(k, step, None) for k in keys], SCHEMA))
            want = dict.fromkeys(keys, (step, None))
        else:
            table.compact()
        seen.append(sorted((k, *v) for k, v in want.items()))
        assert table.latest() == step + 1 and sorted(rows(table.read()), key=str) == sorted(seen[-1], key=str), do
    for version in (1, 5, 8, 11):  # old versions stay as they were
        assert sorted(rows(table.read(version)), key=str) == sorted(seen[version - 1], key=str)


def test_a_reader_sees_one_version(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), SCHEMA, "k")
    table.replace(spark.createDataFrame([("x", 1, "old")], SCHEMA))
    before = table.read()
    part = table._part(spark.createDataFrame([("y", 2, "new")], SCHEMA), "base")  # a writer that hasn't committed
    assert rows(table.read()) == [("x", 1, "old")]
    table._commit(1, [part])
    assert rows(table.read()) == [("y", 2, "new")] and rows(before) == [("x", 1, "old")]
    with pytest.raises(Conflict):
        table._commit(1, [part])  # another writer that began at version 1
    assert table.latest() == 2 and [f.getPath().getName() for f in table._fs.listStatus(table._path("versions")) if f.getPath().getName().startswith("_")] == []


def test_chunks_and_unknown_columns(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), SCHEMA, "k")
    table.insert(spark.range(2500).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("a"), F.lit("b").alias("b")).coalesce(1), chunk=1000)
    assert table.read().count() == 2500
    files = list((tmp_path / "t" / "parts").glob("insert-*/part-*.parquet"))
    assert len(files) == 3
    with pytest.raises(ValueError, match="no such columns"):
        table.update(spark.createDataFrame([("1", 2)], "k string, c int"))
