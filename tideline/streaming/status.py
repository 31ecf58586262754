"""A queue of reports as a log of status changes: the latest status of each, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATES = ("pending", "processing", "completed", "failed")


def latest_status(log: DataFrame) -> DataFrame:
    """(report, status, changes) of a log (report, at, seq, status); seq breaks ties of time."""
    return log.groupBy("report").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.count(F.lit(1)).alias("changes"))


def new_reports(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream (company, rating_date, report, at) without repeats of a company's rating date, as long as they come
    within `late`."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["company", "rating_date"])


def status_stream(stream: DataFrame) -> DataFrame:
    """The latest status of each report, kept in the stream's state."""
    return latest_status(stream)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Changes by status in windows of time; rows later than `late` are left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes all files that are there and stops. The checkpoint is what a later run goes on from, so that no report
    is processed twice. Results other than appended rows go by whole batches."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", target).outputMode("append").start()
    return writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
