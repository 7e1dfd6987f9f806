"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same role and text) is rendered once as the prompt. What follows
on either side is rendered as its completion, with the spans (in code points of the completion) that
carry loss: the text and end mark of assistant turns. All of it is built-in functions; one row holds
one pair, so the largest group is one conversation.

Defined cases: null and empty texts render as empty turns, a null role as the role ``unknown``; two
nulls are the same. Sides that are equal have empty completions; if one side is a prefix of the other,
only its completion is empty. Repeated turns stay, ordered by turn, role and text (nulls first). Rows
without conv_id form no conversation. An empty table gives no rows; extra columns are ignored.

``negatives`` makes pairs of plain conversations, one for each: none is dropped and no turn is cut. A conversation
without an answer is its own prompt; where the neighbour has no answer, or doesn't exist, the rejected completion is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered array of turns."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return (
        turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).cast(TURNS).alias("turns"))
    )


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit(MIDDLE))


def _rendered(t: Column) -> Column:
    return F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Spans of assistant text with its end mark, by one pass that carries the length so far."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc, t):
        after = acc["at"] + F.length(_rendered(t))
        span = F.array(F.struct((acc["at"] + F.length(_head(t))).alias("start"), after.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(after.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` has pair_id and the arrays chosen and rejected; one row per pair comes back."""
    pairs = pairs.select("pair_id", F.col("chosen").cast(TURNS).alias("chosen"), F.col("rejected").cast(TURNS).alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.transform(
        F.slice("chosen", F.lit(1), shorter),
        lambda t, i: ~(t["role"].eqNullSafe(F.get("rejected", i)["role"]) & t["text"].eqNullSafe(F.get("rejected", i)["text"])),
    )
    first = F.array_position(differs, True).cast("int")
    shared = pairs.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(shorter))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.size(side))
    return (
        shared.withColumns({"_c": rest("chosen"), "_r": rest("rejected")})
        .select(
            "pair_id",
            "n_prompt_turns",
            _render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
            _render(F.col("_c")).alias("chosen"),
            _mask(F.col("_c")).alias("chosen_mask"),
            _render(F.col("_r")).alias("rejected"),
            _mask(F.col("_r")).alias("rejected_mask"),
        )
    )


def negatives(talks: DataFrame) -> DataFrame:
    """Pairs from plain conversations, one for each.

    Chosen is the conversation as it is; rejected are its turns before the last answer, followed by what the neighbour
    (ids 2k and 2k + 1) has from its own last answer on. Without an answer all turns come before it.
    """
    at = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()))
    marked = talks.select("conv_id", "turns", at.alias("last"))
    tail = F.slice("turns", F.col("last") + 1, F.size("turns"))
    other = marked.filter("last IS NOT NULL").select(F.expr("conv_id ^ 1").alias("conv_id"), tail.alias("tail"))
    before = F.slice("turns", F.lit(1), F.coalesce("last", F.size("turns")))
    return marked.join(other, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen"),
        F.concat(before, F.coalesce("tail", F.array().cast(TURNS))).alias("rejected"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), a AS (
  SELECT conv_id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS k FROM c
), p AS (
  SELECT a.conv_id, a.t AS ch, list_concat(CASE WHEN a.k IS NULL THEN a.t ELSE a.t[1:a.k - 1] END, CASE WHEN b.k IS NULL THEN [] ELSE b.t[b.k:] END) AS re
  FROM a LEFT JOIN a b ON b.conv_id = xor(a.conv_id, 1)
), q AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(ch), len(re)) + 1),
    lambda i: NOT (ch[i].role IS NOT DISTINCT FROM re[i].role AND ch[i].text IS NOT DISTINCT FROM re[i].text))) - 1, least(len(ch), len(re))) AS n FROM p
), r AS (
  SELECT conv_id, n, ch[n + 1:] AS cs, re[n + 1:] AS rs,
    list_transform(ch, lambda x: '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS s,
    list_transform(re, lambda x: '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS u
  FROM q
), m AS (
  SELECT *, s[n + 1:] AS sc, u[n + 1:] AS uc FROM r
)
SELECT conv_id AS pair_id, n::INT AS n_prompt_turns, sha256(array_to_string(s[1:n], '')) AS prompt_sha256,
  sha256(array_to_string(sc, '')) AS chosen_sha256, sha256(array_to_string(uc, '')) AS rejected_sha256,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(cs) + 1), lambda i: cs[i].role = 'assistant'),
    lambda i: (length(array_to_string(sc[1:i - 1], '')) + 14) || ':' || length(array_to_string(sc[1:i], ''))), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rs) + 1), lambda i: rs[i].role = 'assistant'),
    lambda i: (length(array_to_string(uc[1:i - 1], '')) + 14) || ':' || length(array_to_string(uc[1:i], ''))), ','), '') AS rejected_mask
FROM m
"""


@query("op9_preference_format", SQL)
def op9(spark, folder):
    out = format_pairs(negatives(conversations(table(spark, folder, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(
        "pair_id",
        "n_prompt_turns",
        *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")),
        spans("chosen_mask").alias("chosen_mask"),
        spans("rejected_mask").alias("rejected_mask"),
    )
