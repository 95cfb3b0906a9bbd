"""Chat formatting with every participant in turn as the assistant, in DataFrame operations only.

For each conversation and each participant the whole dialogue is rendered once,
as one row: that participant's messages as the assistant's, all others' as those
of named users, narrators (the system role) as themselves. ``mask`` lists the
character ranges of the rendering that are trained on: the assistant's contents
with their end marks.

One grouping by conversation gathers its messages and participants; a row holds
one conversation, as the rendering itself does, so a conversation must fit a
row (2 GB in Spark). Offsets are summed in blocks of ``BLOCK`` messages, so that a
long dialogue takes time in proportion to its length.

Defined results: messages are ordered by turn, role and text, nulls first; rows
that repeat a message are each rendered, ties being equal messages; a null role
is the speaker ``unknown``, and one with that name is the same speaker; a null
text is empty; a null turn comes first; null conv_ids form one conversation; a
conversation of narrators only has no participant and no row; an empty table
gives no row; very long texts are rendered whole. A speaker named ``assistant`` is
``user name=assistant`` from all perspectives but its own. In contents and names
``<|`` is written ``<\\|`` and in names a line feed ``\\n``, so neither can open or end
a turn. Other columns, whatever their names, are ignored. Ids and turns are whole
numbers; others raise Spark's cast error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NARRATORS = ("system",)
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Messages whose offsets are summed together. It changes no result.
BLOCK = 256


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _head(role: Column, perspective: Column, narrators: tuple[str, ...]) -> Column:
    name = F.when(role == perspective, F.lit("assistant")).when(role.isin(*narrators), role).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(BEGIN), name, F.lit("\n"))


def rotate(conversations: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, perspective, n_messages, rendered, mask ("from-to" joined by commas) and n_masked (characters)."""
    role = F.replace(_escaped(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))), F.lit("\n"), F.lit("\\n"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), _escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).alias("message"),
    )
    speaker = F.when(~F.col("message.role").isin(*narrators), F.col("message.role"))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"), F.collect_set(speaker).alias("speakers"))
    each = each.select("conv_id", "messages", F.explode("speakers").alias("perspective"))

    own = F.col("perspective")
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(_head(m["role"], own, narrators), m["text"], F.lit(END))), "")
    spans_type = "array<struct<lo:bigint,hi:bigint>>"
    zero = F.lit(0).cast("bigint").alias("at")

    def step(acc: Column, m: Column) -> Column:
        lo = acc["at"] + F.length(_head(m["role"], own, narrators))
        hi = lo + F.length(m["text"]) + len(END)
        spans = F.when(m["role"] == own, F.concat(acc["spans"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))).otherwise(acc["spans"])
        return F.struct(hi.alias("at"), spans.alias("spans"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct((s["lo"] + acc["at"]).alias("lo"), (s["hi"] + acc["at"]).alias("hi")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    starts = F.sequence(F.lit(0), F.floor((F.size("messages") - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda k: F.aggregate(F.slice("messages", k * BLOCK + 1, BLOCK), F.struct(zero, F.array().cast(spans_type).alias("spans")), step))
    joined = F.aggregate(blocks, F.struct(zero, F.array().cast(f"array<{spans_type}>").alias("parts")), join)
    out = each.withColumn("spans", F.flatten(joined["parts"]))
    return out.select(
        "conv_id",
        "perspective",
        F.size("messages").cast("bigint").alias("n_messages"),
        rendered.alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["lo"], s["hi"])), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"]).alias("n_masked"),
    )
