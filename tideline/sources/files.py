"""Readers and writers of the forms in which documents come and results go."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import date


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Documents from one array, one object, or an object a line, told apart by the first character and whether the
    first line is whole."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("v")).limit(1).first()
    head = first["v"] if first else ""
    lines = head.startswith("{") and head.endswith("}")
    reader = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def docs_by_code(raw: DataFrame, column: str, item: str) -> DataFrame:
    """Rows (code, item) of JSON {"docs": {code: [item, ...]}}; docs may also be JSON within a string."""
    kind = f"map<string, array<{item}>>"
    inner = F.get_json_object(column, "$.docs")
    return raw.select(F.explode(F.from_json(inner, kind)).alias("code", "docs")).select("code", F.explode("docs").alias("item"))


def promote_header(rows: DataFrame, order: str, is_header: Column, by: str | None = None) -> DataFrame:
    """Sheets whose header stands below other lines: array rows (cells) become maps of header and cell, from the row
    after the first that is a header. Cells beyond the header go."""
    keys = [by] if by else []
    head = rows.where(is_header).groupBy(*keys).agg(F.min(order).alias("_at"), F.min_by("cells", order).alias("_head"))
    # without keys the header is one row
    marked = (rows.join(head, keys) if keys else rows.join(F.broadcast(head))).where(F.col(order) > F.col("_at"))
    n = F.least(F.size("_head"), F.size("cells"))
    return marked.select(*keys, order, F.map_from_arrays(F.slice("_head", F.lit(1), n), F.slice("cells", F.lit(1), n)).alias("row"))


def latest_files(files: DataFrame, key: str, path: str, stamp: str) -> DataFrame:
    """The path with the latest date of each key."""
    return files.groupBy(key).agg(F.max_by(path, F.struct(date(F.col(stamp)), F.col(path))).alias(path))


def flat_columns(df: DataFrame, array: str, fields: list[str], most: int | None = None) -> DataFrame:
    """An array of structs as numbered columns, as many as the longest has, or `most`."""
    n = df.agg(F.max(F.size(array))).first()[0] or 0 if most is None else most
    cols = [F.get(array, F.lit(k))[f].alias(f"{f}_{k + 1}") for k in range(max(n, 0)) for f in fields]
    return df.select(*[c for c in df.columns if c != array], *cols)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_empty: bool = False) -> DataFrame:
    """old with new rows and, where keys meet, new values that are filled (neither null nor empty); with keep_empty an
    empty string overwrites as well. Columns are those of old and new together."""
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    a, b = old.alias("a"), new.alias("b")
    kinds = dict(new.dtypes)

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"a.{c}")
        if c not in old.columns:
            return F.col(f"b.{c}")
        fresh = F.col(f"b.{c}")
        if kinds[c] == "string" and not keep_empty:
            fresh = F.when(fresh != "", fresh)
        return F.coalesce(fresh, F.col(f"a.{c}"))

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[value(c).alias(c) for c in names])


def append_missing(done: DataFrame | None, todo: DataFrame, key: str) -> DataFrame:
    """Rows that were not processed yet."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Null as an empty field; several files, one per task."""
    df.write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def read_by_bank(spark: SparkSession, folder: str, banks: DataFrame, schema: str, stem: str) -> DataFrame:
    """banks (symbol) with the document (of `schema`) that a folder has for each: from `<stem>_<symbol>.json`, else
    `<symbol>_<stem>.json`, with the symbol as it is, else in lower case; else the entry of that symbol, or of it in lower
    case, in `<stem>_all_banks.json`, an object of documents by symbol. `found` is the file's name; null where there is none."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    combined = files.where(F.col("file") == f"{stem}_all_banks.json").select("file", F.explode(F.from_json("value", "map<string,string>")).alias("symbol", "value"))
    ask = F.explode(F.array(*[F.struct(F.lit(rank).alias("rank"), name.alias("name")) for rank, name in enumerate([F.concat(F.lit(f"{stem}_"), "symbol", F.lit(".json")), F.concat(F.lit(f"{stem}_"), F.lower("symbol"), F.lit(".json")), F.concat("symbol", F.lit(f"_{stem}.json")), F.concat(F.lower("symbol"), F.lit(f"_{stem}.json"))])]))
    own = banks.select("symbol", ask.alias("a")).join(files, F.col("a.name") == F.col("file")).select("symbol", F.col("a.rank").alias("rank"), "file", "value")
    entry = F.explode(F.array(F.struct(F.lit(4).alias("rank"), F.col("symbol").alias("name")), F.struct(F.lit(5).alias("rank"), F.lower("symbol").alias("name"))))
    shared = banks.select("symbol", entry.alias("a")).join(combined.withColumnRenamed("symbol", "of"), F.col("a.name") == F.col("of")).select("symbol", F.col("a.rank").alias("rank"), "file", "value")
    best = own.unionByName(shared).groupBy("symbol").agg(F.min(F.struct("rank", "file", "value")).alias("m"))
    return banks.join(best, "symbol", "left").select(*banks.columns, F.col("m.file").alias("found"), F.from_json("m.value", schema).alias("doc"))


def write_json(df: DataFrame, path: str, **meta: object) -> None:
    """Rows as JSON, one a line, in `path`/rows, and in `path`/_meta one object with the count of rows and what is given."""
    df.write.mode("overwrite").json(f"{path}/rows")
    spark = df.sparkSession
    n = spark.read.schema(df.schema).json(f"{path}/rows").count()
    spark.createDataFrame([(json.dumps({"rows": n} | meta, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_meta").first().value)


def purge(nodes: DataFrame, edges: DataFrame, *labels: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, labels) without those that have one of the labels, or without any where none is named, and edges (src,
    dst) without those that had an end among them."""
    gone = nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))) if labels else nodes
    ids = gone.select("node")
    kept = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)
    return nodes.join(ids, "node", "left_anti").select(*nodes.columns), kept


def console_table(df: DataFrame, most: int = 20, width: int = 40) -> str:
    """The first `most` rows by all columns as a table of plain text, cells cut to `width`, and how many rows follow."""
    rows = df.orderBy(*df.columns).limit(most + 1).collect()
    cell = lambda x: ("" if x is None else str(x))[:width]
    lines = [[cell(c) for c in df.columns], *[[cell(x) for x in r] for r in rows[:most]]]
    wide = [max(len(line[k]) for line in lines) for k in range(len(df.columns))]
    out = [" | ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)).rstrip() for line in lines]
    return "\n".join([out[0], "-+-".join("-" * w for w in wide), *out[1:], *(["..."] if len(rows) > most else [])]) + "\n"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(category, name, rank) of a JSON object of lists of names by category; rank is the category's place in the file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("rank", "e"))
    return rows.select(F.col("e.key").alias("category"), F.explode("e.value").alias("name"), "rank")
