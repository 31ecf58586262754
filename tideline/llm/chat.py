"""Chat formatting with typed content parts. DataFrame functions only.

A turn is `<|turn|>role<|text|>content<|end|>`. Content is what a visitor makes of the turn's parts, in order: a text
part gives its text, escaped with that of the text parts beside it; an image, audio or document part gives the placeholder `<|image|>` and so on, and is
recorded in `attachments` with its reference, turn, part and the tokens it expands to.

Control strings inside texts, roles and names are escaped reversibly: a backslash goes behind the first character of
each of them, also where backslashes already stand there; reading back takes one away. So an escaped text holds no
control string, and every text comes back exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that a placeholder of each type stands for where the part itself names no number.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
#: Strings with a meaning in this template or other common ones. None has `<` or `[` but as its first character, so matches never overlap.
CONTROLS = (TURN, TEXT, END, *(f"<|{k}|>" for k in PART_TOKENS), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_INNER = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPE = (rf"([<\[])(\\*(?:{_INNER}))", r"$1\\$2")
UNESCAPE = (rf"([<\[])\\(\\*(?:{_INNER}))", "$1$2")
#: The part schema of `format_conversations`: type, text of a text part, reference and tokens of any other.
PART_TYPE = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens")))


def _mark(part: Column) -> Column:
    """The placeholder of a part, or null: a text part, and one of unknown type, is text."""
    out = F.lit(None).cast("string")
    for kind in PART_TOKENS:
        out = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
    return out


def _content(parts: Column) -> Column:
    """What a visitor makes of the parts: texts that no placeholder parts are joined before they are escaped, so that no
    control string can come of two of them."""
    found = F.filter(F.sequence(F.lit(-1), F.size(parts)), lambda i: (i < 0) | (i >= F.size(parts)) | _mark(F.get(parts, i)).isNotNull())

    def run(marks: Column, after: Column, k: Column) -> Column:
        end = F.get(marks, k + 1)
        texts = F.transform(F.slice(parts, after + 2, F.greatest(end - after - 1, F.lit(0))), lambda p: F.coalesce(p["text"], F.lit("")))
        return F.when(end.isNull(), "").otherwise(F.concat(escape(F.array_join(texts, "")), F.coalesce(_mark(F.get(parts, end)), F.lit(""))))

    # bound by a lambda, so that the places are found once
    return F.get(F.transform(F.array(found), lambda marks: F.array_join(F.transform(marks, lambda after, k: run(marks, after, k)), "")), F.lit(0))


def _tokens(part: Column) -> Column:
    out = F.lit(None).cast("int")
    for kind, n in PART_TOKENS.items():
        out = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(n))).otherwise(out)
    return out


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (start, length of each span under the loss mask, in code
    points of `formatted`), attachments and part_tokens (the sum of what placeholders expand to).

    Turns go by number, then role and content where rows share a number; repeated rows are turns of their own. A null
    role or text counts as empty, null parts as none, and a null turn number comes first. A row without a conversation
    id is a conversation of its own, as nothing says which rows belong together. Turns of the roles in `learn` are under
    the mask, without their marks. Other columns are ignored, whatever their names; an empty table gives no rows. The
    texts of a conversation are gathered in one row, so it has to fit one.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(PART_TYPE))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        _content(parts).alias("content"),
        F.filter(F.transform(parts, lambda p, i: F.struct(F.col(turn_col).alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["tokens"].isNotNull()).alias("refs"),
    )
    marked = rows.select("conv", "alone", "turn", "role", "content", "refs", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head")).withColumn("body", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv", "alone").orderBy("turn", "role", "content")
    # running lengths by a window, since a fold over a long conversation would copy its spans each turn
    marked = marked.withColumn("n", F.row_number().over(order)).withColumn("at", F.sum(F.char_length("body")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.coalesce(F.col("at"), F.lit(0)) + F.char_length("head")
    span = F.when(F.col("role").isin(*learn), F.struct(start.cast("long").alias("start"), F.char_length("content").cast("long").alias("length")))
    piece = marked.select("conv", "alone", F.struct("n", "body", span.alias("span"), "refs").alias("t"))
    whole = piece.groupBy("conv", "alone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    refs = F.flatten(F.col("t.refs"))
    return whole.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.col("t.body"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"),
        refs.alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("part_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The input with turns (role, text, unescaped; placeholders stay) and loss_text, parsed from `formatted` alone."""
    turns = F.filter(F.split("formatted", re.escape(TURN)), lambda x: x != "")
    parsed = F.transform(turns, lambda x: F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.regexp_replace(F.substring_index(x, TEXT, -1), rf"{re.escape(END)}\z", "")).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", parsed).withColumn("loss_text", F.array_join(learned, ""))
