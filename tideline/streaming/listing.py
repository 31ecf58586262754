"""A list of reports that is polled: a streaming source over a folder of pages, read a batch at a time.

The folder stands for a service that lists its reports in pages: files of one JSON object a line, in the order of their
names, to which pages are added. The offset is a page and how many of its lines were read, so that a restart goes on behind
the last report that was processed. What a poll gives is a batch of entries of the list, BATCH of them, which the driver
reads as a client of the service would; what is done for each report is done in tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Reports that one batch processes at most.
BATCH = 10
SCHEMA = "report string, company string, rating_date string, page string, line long"


class _Reader(SimpleDataSourceStreamReader):
    """Reads what comes after an offset, `batch` reports at most."""

    def __init__(self, folder: str, batch: int):
        self.folder, self.batch = folder, batch

    def initialOffset(self) -> dict:
        return {"page": "", "line": 0}

    def _after(self, start: dict) -> Iterator[tuple[dict, tuple]]:
        """The reports behind an offset, each with the offset behind it."""
        for page in sorted(x for x in os.listdir(self.folder) if x.endswith(".jsonl") and x >= start["page"]):
            skip = start["line"] if page == start["page"] else 0
            with open(os.path.join(self.folder, page), encoding="utf-8") as f:
                for k, line in enumerate(f):
                    if k >= skip:
                        x = json.loads(line)
                        yield {"page": page, "line": k + 1}, (x.get("report"), x.get("company"), x.get("rating_date"), page, k)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for at, row in self._after(start):
            if len(rows) == self.batch:
                break
            rows.append(row)
            end = at
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that was planned before a restart, again."""
        last = (end["page"], end["line"])
        for at, row in self._after(start):
            if (at["page"], at["line"]) > last:
                break
            yield row


class ReportList(DataSource):
    """`spark.readStream.format("report_list").option("path", folder).option("batch", 10).load()`. The driver reads the folder."""

    @classmethod
    def name(cls) -> str:
        return "report_list"

    def schema(self) -> str | StructType:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("batch", BATCH)))


def poll(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    """The stream of all reports of a list, `batch` at a time."""
    spark.dataSource.register(ReportList)
    return spark.readStream.format("report_list").option("path", folder).option("batch", batch).load()
