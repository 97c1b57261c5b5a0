"""Prefix-target expansion of conversations: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def expand(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, turn, context_turns, prompt, reply, train_from, train_to) of each reply.

    ``prompt`` is every preceding turn of the conversation as ``<|role|>``, line end, text,
    ``<|end|>``, line end, and then the header of the reply. Of ``prompt`` followed by
    ``reply`` only the characters [train_from, train_to), the reply, are trained on.

    * turns go by number, then role, then text, nulls first; rows that repeat all four
      columns count once, so ties and repeats have one order
    * a null text is empty (an empty reply gives train_from = train_to); a null role is
      ``unknown``; rows without ``conv_id`` belong to no conversation and are left out
    * conversations without such a role, and an empty table, give no rows
    * other columns are ignored, whatever their names

    One shuffle gathers a conversation; its examples are made one at a time, so a long
    conversation needs room for its turns, not for all of its prompts at once.
    """
    t = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    one = conversations.where("conv_id is not null").select(F.col("conv_id").alias("conv_id"), t.alias("t"))
    all_ = one.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    at = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: F.element_at(F.col("ts"), i + 1)["role"] == role)
    each = all_.select("conv_id", "ts", F.explode(at).alias("i"))
    header = lambda r: F.concat(F.lit("<|"), F.coalesce(r, F.lit("unknown")), F.lit("|>\n"))
    turns = F.transform(F.slice("ts", F.lit(1), F.col("i")), lambda x: F.concat(header(x["role"]), F.coalesce(x["text"], F.lit("")), F.lit(END)))
    own = F.element_at(F.col("ts"), F.col("i") + 1)
    got = each.select("conv_id", own["turn"].alias("turn"), F.col("i").alias("context_turns"), F.concat(F.array_join(turns, ""), header(F.lit(role))).alias("prompt"), F.coalesce(own["text"], F.lit("")).alias("reply"))
    return got.withColumn("train_from", F.length("prompt")).withColumn("train_to", F.length("prompt") + F.length("reply"))


EXPAND_SQL = r"""WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT *, count(*) OVER o AS context_turns,
    coalesce(string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER o, '') || '<|assistant|>' || chr(10) AS prompt
    FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, context_turns::INT AS context_turns, prompt, coalesce(text, '') AS reply, length(prompt)::INT AS train_from,
    (length(prompt) + length(coalesce(text, '')))::INT AS train_to FROM w WHERE role = 'assistant'"""
