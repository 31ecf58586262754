"""Rows from HTML and XML: tables of pages, and facts of business reports."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Facts that make a batch.
FACTS = 20000


class _Tables(HTMLParser):
    """Collects the cells of all tables, rows in order; a nested table's cells count to the outer cell's text too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.table, self.row, self.cells, self.text = -1, 0, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.table, self.row = self.table + 1, 0
        elif tag == "tr":
            self._end_row()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self._end_cell()
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def _end_cell(self) -> None:
        if self.text is not None and self.cells is not None:
            self.cells.append(" ".join("".join(self.text).split()))
        self.text = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.cells:
            self.rows.append((self.table, self.row, self.cells))
            self.row += 1
        self.cells = None


def table_rows(html: str | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    p._end_row()
    return p.rows


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, row_no, cells) of all tables of all pages."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, h in zip(b["id"], b["html"], strict=True) for r in table_rows(h)]
            yield pd.DataFrame(rows, columns=["id", "table_no", "row_no", "cells"])

    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return base.mapInPandas(run, "id long, table_no int, row_no int, cells array<string>").withColumnRenamed("id", id_col)


@cache
def _local(tag: str) -> str:
    return _last(tag)


def _last(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def facts(xml: str | None) -> list[tuple[int, str, str, dict[str, str | None], str | None, str]]:
    """(seq, name, context, dimensions, end, value) of each fact of a report. Dimensions are a map of the axes of its
    context, in segment and scenario, to their members, or to null where a member is typed; end is the context's last day."""
    if not (xml or "").strip():
        return []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    contexts: dict[str, tuple[dict[str, str | None], str | None]] = {}
    for c in root.iter():
        if _local(c.tag) == "context":
            dims, end = {}, None
            for m in c.iter():
                kind = _local(m.tag)
                if kind in ("explicitMember", "typedMember"):
                    dims[_last(m.get("dimension", ""))] = _last((m.text or "").strip()) if kind == "explicitMember" else None
                elif kind in ("endDate", "instant"):
                    end = (m.text or "").strip() or None
            contexts[c.get("id", "")] = dims, end
    out = []
    for e in root:
        ref = e.get("contextRef")
        if ref is not None:
            dims, end = contexts.get(ref, ({}, None))
            out.append((len(out), _local(e.tag), ref, dims, end, (e.text or "").strip()))
    return out


def xbrl_facts(files: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """The facts of each report as a long table: id, seq, name (first letter small), context, dims, end, value, number. A text
    that isn't well-formed has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, xml = b.column(0), b.column(1)
            at, rows = [], []
            for k in range(b.num_rows):
                found = facts(xml[k].as_py())
                at += [k] * len(found)
                rows += found
                # as many reports as make a batch of facts, at least one
                if rows and (len(rows) >= FACTS or k + 1 == b.num_rows):
                    seq, name, context, dims, end, value = zip(*rows, strict=True)
                    text = [pa.array(c, pa.string()) for c in (end, value)]
                    made = [ids.take(pa.array(at)), pa.array(seq, pa.int32()), pa.array(name, pa.string()), pa.array(context, pa.string()), pa.array([list(d.items()) for d in dims], pa.map_(pa.string(), pa.string())), *text]
                    yield pa.RecordBatch.from_arrays(made, ["id", "seq", "name", "context", "dims", "end", "value"])
                    at, rows = [], []

    kind = dict(files.dtypes)[id_col]
    base = files.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml"))
    out = base.mapInArrow(run, f"id {kind}, seq int, name string, context string, dims map<string,string>, end string, value string")
    camel = F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    return out.withColumn("name", camel).withColumn("number", F.col("value").try_cast("double")).withColumnRenamed("id", id_col)


# The axis of categories, what the axes of entities have in their names, and the category of the whole.
CATEGORY_AXIS, DETAILS, WHOLE = "CategoryOfShareholdersAxis", "Details", "ShareholdingPatternMember"
#: Figures of a whole report by the names that they go by, the first that is there.
FIGURES = {"shares": ("numberOfShares", "totalNumberOfShares"), "holders": ("numberOfShareholders",)}


def _places() -> Column:
    """Where a fact counts: a list of (part, axis, member)."""
    entries = F.filter(F.map_entries("dims"), lambda e: F.contains(e["key"], F.lit(DETAILS)))
    opaque = F.regexp_replace("context", "^D_", "")
    entity = F.transform(entries, lambda e: F.struct(F.lit("entity").alias("part"), e["key"].alias("axis"), F.coalesce(e["value"], opaque).alias("member")))
    one = lambda part, axis, member: F.array(F.struct(F.lit(part).alias("part"), F.lit(axis).cast("string").alias("axis"), member.cast("string").alias("member")))
    category = F.try_element_at("dims", F.lit(CATEGORY_AXIS))
    return F.when(F.size("dims") == 0, one("total", None, F.lit(None))).when(F.size(entries) > 0, entity).when(category.isNotNull(), one("aggregate", CATEGORY_AXIS, category))


def route_facts(long: DataFrame, id_col: str) -> DataFrame:
    """(id, part, axis, member, name, value, number) of facts, routed by the dimensions of their contexts: without any they
    are `total`; with an axis of details `entity`, under every such axis, by its member or, for typed ones, the context
    without its `D_`; with a category only `aggregate`, by category. Facts of other dimensions go. Of facts of one place and
    name the last counts."""
    rows = long.withColumn("p", F.explode(_places()))
    last = rows.groupBy(id_col, "p", "name").agg(F.max_by(F.struct("value", "number"), "seq").alias("m"))
    return last.select(id_col, "p.part", "p.axis", "p.member", "name", "m.value", "m.number")


def report_figures(long: DataFrame, id_col: str) -> DataFrame:
    """(id, end, shares, holders, categories, entities) of each report's facts: the first fact's last day that is known, the
    figures of the whole category, or else of the totals (a figure of 0 counts as missing), and how many categories and
    entities there are."""
    # the facts are read once, those without a place too, and shuffled once, by report
    rows = long.select(id_col, "seq", "name", "end", "number", F.explode_outer(_places()).alias("p")).repartition(id_col)
    first = F.min(F.when(F.col("end").isNotNull(), F.struct("seq", "end")))
    routed = rows.groupBy(id_col, "p", "name").agg(F.max_by("number", "seq").alias("number"), first.alias("first"))
    value = F.when(F.col("number") != 0, F.col("number"))
    part = F.col("p.part")
    whole = (part == "aggregate") & (F.col("p.member") == WHOLE)
    figures, wanted = [], []
    for figure, names in FIGURES.items():
        found = [F.when(test & (F.col("name") == n), value) for test in (whole, part == "total") for n in names]
        figures += [F.max(c).alias(f"{figure}{k}") for k, c in enumerate(found)]
        wanted.append(F.coalesce(*[F.max(f"{figure}{k}") for k in range(len(found))]).alias(figure))
    # a place once, whatever names it has
    of_place = routed.groupBy(id_col, "p").agg(*figures, F.min("first").alias("first"))
    count = lambda kind: F.count_if(part == kind)
    sums = of_place.groupBy(id_col).agg(F.min("first")["end"].alias("end"), *wanted, count("aggregate").alias("categories"), count("entity").alias("entities"), F.count("p").alias("places"))
    return sums.where("places > 0").select(id_col, "end", *FIGURES, "categories", "entities")
