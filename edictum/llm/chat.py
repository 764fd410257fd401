"""Op 2: preference formatting of chosen and rejected conversations.

A pair's two conversations are put in turn order; their longest common prefix of equal
turns (role and text) is rendered once as the prompt; the rest of each is rendered as a
completion with a loss mask: the characters of assistant turns count, others do not.
A turn is rendered as ``<|role|>`` newline text ``<|end|>`` newline.  Masks are run
lengths ``flag:characters`` joined by commas, flag 1 where the loss counts.

Conversations 2k and 2k + 1 form pair k: the even one is chosen.  A pair with one
conversation only has the other completion null and an empty prompt.

Conversations are gathered by pair: a training example is one row, so its turns must fit
a row anyway.  Rows without conv_id belong to no pair and are left out.  Null roles and
texts are empty; equal turn numbers are ordered by role and text, null first; repeated rows
repeat the turn; a pair of equal conversations is all prompt, with empty completions; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    def part(t: Column) -> Column:
        size = F.length(t["role"]) + F.length(t["text"]) + 13
        return F.concat(F.when(t["role"] == "assistant", "1:").otherwise("0:"), size.cast("string"))

    return F.array_join(F.transform(turns, part), ",")


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"),
        F.col("conv_id").cast("long").bitwiseAND(F.lit(1)).alias("side"),
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(n) for s, n in ((0, "c"), (1, "r"))]
    pairs = rows.groupBy("pair_id").agg(*sides)
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    pairs = pairs.withColumn("_differ", F.array_position(same, False)).withColumn(
        "n_prompt_turns", F.when(F.col("_differ") > 0, F.col("_differ") - 1).otherwise(F.size("c")).cast("int")
    )
    at = F.col("n_prompt_turns")

    def rest(side: str) -> Column:
        return F.slice(side, at + 1, F.greatest(F.size(side) - at, F.lit(0)))

    return pairs.select(
        "pair_id",
        "n_prompt_turns",
        _render(F.slice("c", F.lit(1), at)).alias("prompt"),
        *[
            F.when(F.size(side) > 0, made(rest(side))).alias(name + suffix)
            for side, name in (("c", "chosen"), ("r", "rejected"))
            for suffix, made in (("", _render), ("_mask", _mask))
        ],
    )


ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT pair_id, i, max(role) FILTER (side = 0) AS cr, max(text) FILTER (side = 0) AS ct,
         max(role) FILTER (side = 1) AS rr, max(text) FILTER (side = 1) AS rt
  FROM t GROUP BY pair_id, i),
p AS (
  SELECT pair_id, coalesce(min(i) FILTER (cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt) - 1, max(i)) AS n FROM m GROUP BY pair_id),
r AS (
  SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
         CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END || (length(role) + length(text) + 13) AS mask
  FROM t JOIN p USING (pair_id))
SELECT pair_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n), '') END AS chosen,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(mask, ',' ORDER BY i) FILTER (side = 0 AND i > n), '') END AS chosen_mask,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n), '') END AS rejected,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(mask, ',' ORDER BY i) FILTER (side = 1 AND i > n), '') END AS rejected_mask
FROM r GROUP BY pair_id
"""
