r"""Chat formatting in budgeted windows, with built-in functions only.

A conversation's turns are put in order and their tokens summed up as they go. The leading system
turns are kept in every window. The others fall into spans by their running sum: a span ends at a
turn, and holds at most ``budget - history - system`` tokens unless one turn alone is longer than half of
that. Each later window begins with those last turns of the span before it that fit into ``history``
tokens. Such repeated turns, and the repeated system turns, stand outside the loss mask; every assistant
turn is inside it in just one window.

A turn is written as ``<turn ROLE>TEXT</turn>`` and a line end. In roles and texts ``\``, ``<`` and ``>`` are
written ``\b``, ``\l`` and ``\g``, so that nothing inside them reads as a control string and all of it
comes back.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then role, then
text, and repeated rows are turns of their own; a null conversation id is a conversation; a system turn
that follows another role is an ordinary turn; other columns are not read; no rows give no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import words_of

#: Fixed values of the template: character, and how it is written inside roles and texts.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Words, and four for the marks of a turn."""
    return F.size(words_of(text, r"[ \t\n\x0B\f\r]")) + 4


def windows(turns: DataFrame, budget: int = 512, history: int = 128, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each window: conversation, window, formatted, n_repeated (turns at its start that
    stand in an earlier window too) and loss, the spans (start, length) in code points under the mask."""
    whole = Window.partitionBy("conv")
    order = whole.orderBy("turn", "role", "text")
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("text")).cast("long"))
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("lead", F.max(F.when(F.col("role") != "system", 1).otherwise(0)).over(sofar) == 0)
    used = F.when(F.col("lead"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("sum", F.sum(used).over(sofar)).withColumn("kept", F.sum(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).over(whole))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("kept")) / 2))
    rows = rows.withColumn("span", F.when(~F.col("lead"), F.floor((F.col("sum") - 1) / stride)))
    rows = rows.withColumn("span", F.coalesce("span", F.min("span").over(whole), F.lit(0)))
    rows = rows.withColumn("span", F.dense_rank().over(whole.orderBy("span")) - 1).withColumn("last", F.max("span").over(whole))
    rows = rows.withColumn("until", F.max("sum").over(Window.partitionBy("conv", "span")))
    again = F.when(F.col("lead"), F.sequence(F.col("span") + 1, F.col("last"))).when(F.col("until") - F.col("sum") + F.col("tokens") <= history, F.array(F.col("span") + 1))
    again = F.when(F.col("span") < F.col("last"), again)
    places = F.concat(
        F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("repeated"))),
        F.coalesce(F.transform(again, lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeated"))), F.array().cast("array<struct<window:int,repeated:boolean>>")),
    )
    head, body = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)), escaped(F.col("text"))
    put = rows.select("conv", "at", (F.col("role") == "assistant").alias("target"), head.alias("head"), body.alias("body"), F.inline(places))
    put = put.withColumn("chars", F.char_length("head") + F.char_length("body") + len(END))
    inside = Window.partitionBy("conv", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = put.withColumn("start", F.sum("chars").over(inside) - F.col("chars") + F.char_length("head"))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("text"), "repeated", "target", "start", F.char_length("body").alias("length"))
    out = put.groupBy("conv", "window").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return out.select(
        F.col("conv").alias(conversation),
        "window",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.size(F.filter("pieces", lambda p: p["repeated"])).alias("n_repeated"),
        F.transform(F.filter("pieces", lambda p: p["target"] & ~p["repeated"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss"),
    )


def turns(formatted: Column, n_repeated: Column) -> Column:
    """A window's own turns as structs of role and text, read back from what was written."""
    written = F.split(formatted, END)
    own = F.slice(written, n_repeated + 1, F.size(written) - 1 - n_repeated)
    return F.transform(
        own,
        lambda x: F.struct(
            unescaped(F.substr(F.substring_index(x, CLOSE, 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(x, F.char_length(F.substring_index(x, CLOSE, 1)) + 2)).alias("text"),
        ),
    )


def under_mask(formatted: Column, loss: Column) -> Column:
    """The texts under a window's loss mask."""
    return F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
