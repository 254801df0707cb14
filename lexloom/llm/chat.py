r"""Chat formatting in relational form, with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn (then role and text); adjacent turns of one role
are merged under one header by array functions, and everything is concatenated:

    ### user
    first text</turn>
    second text of the same role</turn>
    ### assistant
    answer</turn>

Inside texts and roles a backslash goes before the second # of any three in a row, before the slash of </turn>, and
before a backslash; in roles also before a line break. So no control string occurs inside a text, and dropping each
escaping backslash gives the text back. `loss` lists the (start, length) of each assistant text in the output, in
code points from 0.

Defined results: null text is empty; a null role is the empty role; null turns come first; repeated rows are separate
turns; a null conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAD, END = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=##)", "#\\\\")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted string, loss array<struct<start,length>>), one row a conversation."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))
    row = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    sorted_ = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    shifted = sorted_.withColumn("before", F.concat(F.array(F.lit(None).cast("string")), F.transform("t", lambda x: x["role"])))
    paired = shifted.withColumn("t", F.expr("filter(arrays_zip(t, before), x -> x.t is not null)"))
    # a merged block starts where the role changes; each turn's piece is its header, if it starts one, and its text
    pieces = paired.withColumn("t", F.transform("t", lambda x: F.struct(
        F.when(x["before"].eqNullSafe(x["t"]["role"]), F.lit("")).otherwise(F.concat(F.lit(HEAD), x["t"]["head"], F.lit("\n"))).alias("head"),
        x["t"]["body"].alias("body"), (x["t"]["role"] == learn).alias("learned"))))
    blank = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    def step(acc, x):
        start = acc["at"] + F.length(x["head"])
        size = F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END)).alias("at"), F.when(x["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
    return pieces.select(
        "conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("t", blank, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """From the formatted strings alone: conv_id, turns array<struct<role,text>>, learned array<string> (the texts
    under the loss mask)."""
    blocks = F.filter(F.split("formatted", F.lit(HEAD), -1), lambda b: b != "")
    head = F.lit(r"^((?:[^\\\n]|\\[\s\S])*)\n")
    def turns(block):
        role = unescape(F.regexp_extract(block, r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1))
        texts = F.split(F.regexp_replace(block, r"^(?:[^\\\n]|\\[\s\S])*+\n", ""), F.lit(END), -1)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), learned.alias("learned"))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of conversations that were read back."""
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same result in DuckDB.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS fresh,
  length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + 8 + CASE WHEN fresh THEN 5 + length(role) ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
