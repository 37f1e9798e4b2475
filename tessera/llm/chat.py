"""Chat formatting in Spark expressions only.

A conversation's turns are collected, sorted by turn (ties by role, then text) and merged where neighbours have one
role. A block reads START role TEXT text (NEXT text)* END, so its turns can be read back one by one. Control strings
inside roles and texts are replaced by escapes that no control string contains, so that nothing said can end a turn.

Null texts and null roles count as empty. Rows with null conv_id form one conversation. A null turn number sorts first.
Repeated rows are turns of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: Strings that mean something in this template or in common ones, and what stands for them; the escape sign first.
ESCAPES = (("~", "~0"), ("<|", "~1"), ("|>", "~2"), ("<s>", "~3"), ("</s>", "~4"), ("[INST]", "~5"), ("[/INST]", "~6"))
#: The role whose texts are under the loss mask.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def format_chats(df: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points of `formatted`, one for each learnt text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = df.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    turn = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    block = "array<struct<role:string,texts:array<string>>>"

    def merged(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        longer = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))))
        return F.when((F.size(blocks) > 0) & (last["role"] == t["role"]), longer).otherwise(F.concat(blocks, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))).cast(block)

    blocks = turns.select("conv_id", F.aggregate(turn, F.array().cast(block), merged).alias("blocks"))
    # each text with what stands before it; the last END follows all
    parts = F.flatten(F.transform("blocks", lambda b, i: F.transform(b["texts"], lambda x, k: F.struct(F.when(k > 0, F.lit(NEXT)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), b["role"], F.lit(TEXT))).alias("before"), x.alias("text"), (b["role"] == LEARNT).alias("learnt")))))
    told = blocks.select("conv_id", parts.alias("parts"))
    spans = "struct<at:int,spans:array<struct<start:int,length:int>>>"

    def walk(acc: Column, p: Column) -> Column:
        start, size = acc["at"] + F.length(p["before"]), F.length(p["text"])
        return F.struct((start + size).alias("at"), F.when(p["learnt"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(acc["spans"]).alias("spans")).cast(spans)

    return told.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(spans), walk)["spans"].alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """array of (role, text): the turns, read back from the formatted string."""
    quoted = lambda s: s.replace("|", "\\|")
    blocks = F.transform(F.filter(F.split(formatted, quoted(START), -1), lambda b, i: i > 0), lambda b: F.substring_index(b, END, 1))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.substring_index(b, TEXT, -1), quoted(NEXT), -1), lambda x: F.struct(unescape(F.substring_index(b, TEXT, 1)).alias("role"), unescape(x).alias("text")))))


def learnt_texts(formatted: Column, spans: Column) -> Column:
    """array of what stands under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
