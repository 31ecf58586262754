"""The state machine and the polled list over several batches and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.streaming import listing, machine

EVENTS = "report string, at string, seq long, status string"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machine.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_legal_changes_and_time_limits(rocks, tmp_path):
    spark, folder = rocks, str(tmp_path / "in")
    add = lambda rows: spark.createDataFrame(rows, EVENTS).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"

    def run():
        stream = spark.readStream.schema("report string, at timestamp, seq long, status string").parquet(folder)
        q = machine.status_changes(stream).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination(120)
        assert q.exception() is None

    add([("a", at(0), 1, "pending"), ("a", at(1), 2, "processing"), ("b", at(0), 3, "completed"), ("b", at(0), 4, "pending"), ("c", at(0), 5, "pending"), ("c", at(0), 6, "pending"), ("c", at(1), 7, "processing"), ("c", at(2), 8, "completed"), (None, at(2), 9, "pending"), ("x", at(2), 9, None)])
    run()
    # a second run, from the checkpoint: `a` has been in processing for over ten minutes when time gets to minute 30
    add([("c", at(3), 10, "pending"), ("d", at(30), 11, "pending"), ("d", at(30), 12, "odd")])
    run()
    add([("a", at(31), 13, "completed"), ("a", at(32), 14, "pending"), ("d", at(33), 15, "processing"), ("d", at(34), 16, "failed"), ("d", at(35), 17, "pending")])
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {}
    for r in rows.orderBy("at", "was").collect():
        got.setdefault(r.report, []).append((r.was, r.status, r.outcome))
    assert set(got) == {"a", "b", "c", "d"}
    assert sorted(got["a"]) == sorted([("new", "pending", "done"), ("pending", "processing", "done"), ("processing", "failed", "timed out"), ("failed", "completed", "refused"), ("failed", "pending", "done")])
    assert sorted(got["b"]) == sorted([("new", "completed", "refused"), ("new", "pending", "done")])
    assert sorted(got["c"]) == sorted([("new", "pending", "done"), ("pending", "pending", "repeated"), ("pending", "processing", "done"), ("processing", "completed", "done"), ("completed", "pending", "refused")])
    assert sorted(got["d"]) == sorted([("new", "pending", "done"), ("pending", "odd", "refused"), ("pending", "processing", "done"), ("processing", "failed", "done"), ("failed", "pending", "done")])
    assert {r.report: r.status for r in machine.state_of(rows).collect()} == {"a": "pending", "b": "pending", "c": "completed", "d": "pending"}


def test_a_polled_list_is_read_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "list"
    folder.mkdir()

    def page(k, ids):
        (folder / f"page{k:03d}.jsonl").write_text("".join(json.dumps({"report": f"r{i}", "company": f"c{i % 3}", "rating_date": "2024-01-01"}) + "\n" for i in ids))

    sizes = []

    def run():
        def keep(df, _):
            sizes.append(df.count())
            df.write.mode("append").parquet(str(tmp_path / "out"))

        q = listing.poll(spark, str(folder), 4).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
        q.processAllAvailable()
        q.stop()

    page(0, range(6))
    page(1, range(6, 9))
    run()
    page(2, range(9, 20))
    page(3, [])
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(int(r.report[1:]) for r in rows) == list(range(20)) and max(sizes) <= 4 and sum(sizes) == 20
    assert {(r.page, r.line) for r in rows if r.report == "r7"} == {("page001.jsonl", 1)}
