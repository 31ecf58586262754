"""Sheets of many files: CSV and XLSX in a folder, each with its header somewhere, as one table.

Files are read whole in tasks, one by one, as cells by row. Where a sheet's header stands is an aggregate over its rows, which
is joined to those below it; so files of different layouts come together by the names in their headers.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import number
from ..functions.metrics import metric_name
from ..functions.predicates import is_summary

# What a header has above the banks' names, headings between the rows, and cells that hold no value.
BANK_HEADERS = ("banks", "name of the bank", "name of bank")
HEADINGS = ("nan", "none", "", "old private sector banks", "new private sector banks", "nationalised banks", "state bank of india", "private sector banks")
NO_VALUE = ("-", "NA", "nan", "c", "#", "*")


def _column(ref: str) -> int:
    """The number, from 0, of a cell's column by its reference, as in AB12."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a workbook, sheets in their order; rows that are left out in the file are empty."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [text(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        target = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
            ref = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            at = 0
            for row in (e for e in ET.fromstring(z.read("xl/" + target[ref].removeprefix("/xl/"))).iter() if local(e) == "row"):
                cells: list[str | None] = []
                for k, c in enumerate(x for x in row if local(x) == "c"):
                    n = _column(c.get("r", "")) if c.get("r") else k
                    cells += [None] * (n + 1 - len(cells))
                    value = next((x.text for x in c if local(x) == "v"), None)
                    cells[n] = text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
                n = int(row.get("r", at + 1)) - 1
                for gap in range(at, n):
                    yield sheet.get("name", ""), gap, []
                yield sheet.get("name", ""), n, cells
                at = n + 1


def csv_cells(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    for n, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")))):
        yield "", n, [c if c != "" else None for c in row]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, n, cells) of all CSV and XLSX files below a folder; other files, and workbooks that can't be read, are
    left out. A file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(csv|xlsx)$")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(at, *r) for r in (xlsx_cells if at.lower().endswith(".xlsx") else csv_cells)(content)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    continue
                yield pd.DataFrame(rows, columns=["file", "sheet", "n", "cells"])

    return files.mapInPandas(run, "file string, sheet string, n int, cells array<string>")


def suffixed(names: Column) -> Column:
    """An array of column names in which repeated ones get .1, .2 and so on; names that are missing or blank stay null. A
    suffix that makes a name that is there already is passed over."""
    clean = F.transform(names, lambda x: F.nullif(F.trim(x), F.lit("")))

    def place(done: Column, x: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.size(done) + F.size(clean)), lambda k: F.when(k == 0, x).otherwise(F.concat(x, F.lit("."), k.cast("string"))))
        return F.concat(done, F.array(F.when(x.isNotNull(), F.get(F.filter(tries, lambda t: ~F.coalesce(F.array_contains(done, t), F.lit(False)) & ((t == x) | ~F.coalesce(F.array_contains(clean, t), F.lit(False)))), F.lit(0)))))

    return F.aggregate(clean, F.array().cast("array<string>"), place)


def _fill_right(cells: Column) -> Column:
    """Each cell, or where it is empty the last one before it that isn't."""
    full = F.transform(cells, lambda x: F.nullif(F.trim(x), F.lit("")))
    return F.aggregate(full, F.array().cast("array<string>"), lambda done, x: F.concat(done, F.array(F.coalesce(x, F.get(done, F.size(done) - 1)))))


def with_header(cells: DataFrame, titles: tuple[str, ...] = BANK_HEADERS) -> DataFrame:
    """The rows below the header of their sheet, (file, sheet, n, cells, head, at, key): the header is the first row with
    one of `titles` (in any case), `key` the place of that cell in it, `at` the header's row. Sheets without go."""
    found = cells.select("file", "sheet", "n", "cells", F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(*titles)).alias("hits")).where(F.exists("hits", lambda h: h))
    head = found.groupBy("file", "sheet").agg(F.min(F.struct("n", "cells", "hits")).alias("h")).select("file", "sheet", F.col("h.n").alias("at"), F.col("h.cells").alias("head"), (F.array_position("h.hits", True) - 1).cast("int").alias("key"))
    return cells.join(head, ["file", "sheet"]).where("n > at")


def read_tables(cells: DataFrame, titles: tuple[str, ...] = BANK_HEADERS) -> DataFrame:
    """(file, sheet, n, row) of sheets with a header, a row being a map of its names, repeated ones with a suffix, to its
    cells; cells without a name, and rows without a key or of totals and headings, go."""
    named = with_header(cells, titles).withColumn("names", suffixed(F.col("head")))
    keys = F.trim(F.get("cells", F.col("key")))
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda p: p["names"].isNotNull())
    kept = named.where(~is_summary(keys, HEADINGS))
    return kept.select("file", "sheet", "n", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["names"], p["cells"]))).alias("row"))


def union_by_name(tables: DataFrame) -> DataFrame:
    """The rows of all sheets under one header, of all names that any has; a job lists them."""
    names = [r[0] for r in tables.select(F.explode(F.map_keys("row")).alias("k")).distinct().orderBy("k").collect()]
    return tables.select("file", "sheet", "n", *[F.try_element_at("row", F.lit(k)).alias(k) for k in names])


def bank_metrics(cells: DataFrame) -> DataFrame:
    """(file, sheet, bank, metric, year, value, text) of sheets with metrics above years: the header's names go on to the right
    over empty cells, the row below has the years, from 2020 to 2029. Metrics have their standard names; a value that is no
    number is null, with its text beside it."""
    rows = with_header(cells)
    below = rows.where("n = at + 1").select("file", "sheet", F.col("cells").alias("years"))
    wide = rows.join(below, ["file", "sheet"]).withColumn("metrics", _fill_right(F.col("head")))
    bank = F.trim(F.get("cells", F.col("key")))
    cell = F.explode(F.filter(F.transform("cells", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda c: (c["i"] > F.col("key")) & c["x"].isNotNull() & ~c["x"].isin("", *NO_VALUE)))
    long = wide.where(~is_summary(bank, HEADINGS)).select("file", "sheet", bank.alias("bank"), "metrics", "years", cell.alias("c"))
    metric = F.get("metrics", F.col("c.i"))
    year = F.nullif(F.regexp_extract(F.coalesce(F.get("years", F.col("c.i")), F.lit("")), r"202\d", 0), F.lit("")).cast("int")
    some = long.where(metric.isNotNull() & ~F.lower(metric).isin("nan", "none") & ~F.lower(metric).contains("unnamed") & year.isNotNull())
    return some.select("file", "sheet", "bank", metric_name(metric).alias("metric"), year.alias("year"), number(F.col("c.x")).alias("value"), F.col("c.x").alias("text"))
