"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, cut into blocks of adjacent turns of one role, and
concatenated. A block has one header, ``### <role>: ``; every turn in it ends with ``</turn>``; a block ends with a
line feed. Texts and roles are escaped so that no header or end mark can occur inside them, and the escape can be
undone: backslash, ``#``, ``<`` and, in roles, ``:`` become two characters each.

Defined cases: a null text or role is the empty string; a null conv_id is a conversation of its own; turns that tie
on ``turn`` are ordered by role, then text; a null ``turn`` sorts first; repeated rows are turns like any other;
an empty table gives no rows; further columns are ignored. No conversation is cut: one conversation is one output
row, so its turns meet in one task; a salt would change nothing about that row's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

END = "</turn>"
# Each pair: character, what stands for it. Backslash first when escaping, last when undoing.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: The conversation that probes the escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    for plain, mark in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescape(c: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row for each conversation, from rows (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).withColumn("n", F.size("ts"))
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"])),
    )
    blocks = F.transform(
        "starts",
        lambda s, j: F.slice("ts", s, F.coalesce(F.get("starts", j + 1), F.col("n") + 1) - s),
    )
    body = lambda block: F.aggregate(F.transform(block, lambda t: F.concat(escape(t["text"]), F.lit(END))), F.array().cast("array<string>"), lambda acc, x: F.array_append(acc, x), lambda acc: F.array_join(acc, ""))
    formatted = F.transform("blocks", lambda b: F.concat(F.lit("### "), escape(b[0]["role"]), F.lit(": "), body(b), F.lit("\n")))
    return starts.withColumn("blocks", blocks).select("conv_id", F.array_join(formatted, "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns (role, text) that the formatted text holds, parsed from it alone."""
    # Each block begins with "### ", which occurs nowhere else; the piece before the first is empty.
    pieces = F.slice(F.split("formatted", "### "), 2, F.length("formatted") + 1)
    blocks = F.transform(pieces, lambda p: F.struct(F.substring_index(p, ": ", 1).alias("role"), F.substr(p, F.length(F.substring_index(p, ": ", 1)) + 3, F.length(p)).alias("body")))
    texts = lambda b: F.split(F.substr(b["body"], F.lit(1), F.length(b["body"]) - 1 - len(END)), END)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda x: F.struct(unescape(b["role"]).alias("role"), unescape(x).alias("text")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def loss_text(turns: str = "turns") -> Column:
    """All text under the loss mask: the texts of assistant turns, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = read_back(format_conversations(conversations.unionByName(probe))).withColumn("loss", loss_text())
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t
), e as (
  select *, case when before is null or before <> role then 1 else 0 end as head,
    length(replace(replace(replace(replace(text, '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c')) as text_chars,
    length(replace(replace(replace(replace(role, '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c')) as role_chars from o
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_chars + 7 + head * (role_chars + 7)) as bigint) as formatted_chars
from e group by conv_id
"""
