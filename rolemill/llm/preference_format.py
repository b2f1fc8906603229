"""Preference formatting of conversations; DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as
the prompt. What follows on either side is that side's completion, with the character spans of
the assistant's words in it; only these carry loss.

Defined results: turns are ordered by number (null last), then role, then text; equal rows of a
conversation count once; a null role or text is empty; rows without conversation id belong to no
conversation and give none; where both sides are equal both completions are empty and
``has_preference`` is false; an empty table gives no rows. A conversation is one record and is
rendered whole, so its own turns must fit in a task, and a very long text is a part of it; nothing else
is gathered. Extra columns stay; one with the name of an added column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import read, spread_row

TRAINED_ROLE = "assistant"
ADDED = ["n_common", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans", "has_preference"]


def gather_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): each conversation's turns in order, repeated rows once."""
    turn = F.struct(
        F.col("turn").isNull().alias("unnumbered"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = turns.where(F.col(id_col).isNotNull())
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_set(turn)).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _render(t: Column) -> Column:
    return F.concat(_head(t), t["text"], F.lit("<|end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column) -> Column:
    """'start-end' of each trained stretch of the rendered turns, joined by commas."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + F.length(_head(t))
        end = acc["pos"] + F.length(_render(t))
        span = F.concat_ws("-", start.cast("string"), end.cast("string"))
        longer = F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("pos"), longer.alias("spans"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the two turn arrays by prompt, completions and their trained spans."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    cut = F.coalesce(F.array_position(same, False), F.lit(0))
    common = F.when(cut == 0, F.size(same)).otherwise(cut - 1).cast("int")
    keep = [c for c in pairs.columns if c not in (chosen, rejected)]
    # columns of any name may stand beside the two sides, so they are one struct meanwhile
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    cutted = pairs.select(row, chosen, rejected).withColumn("n_common", common)
    tail = {
        side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
        for side in (chosen, rejected)
    }
    out = cutted.select(
        "row",
        "n_common",
        _text(F.slice(chosen, F.lit(1), F.col("n_common"))).alias("prompt"),
        _text(tail[chosen]).alias("chosen_completion"),
        _spans(tail[chosen]).alias("chosen_spans"),
        _text(tail[rejected]).alias("rejected_completion"),
        _spans(tail[rejected]).alias("rejected_spans"),
    )
    return spread_row(out.withColumn("has_preference", F.col("chosen_completion") != F.col("rejected_completion")), keep, ADDED)


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs of a table of plain conversations.

    Chosen is a conversation up to its last assistant turn; rejected is the same with that reply
    taken from the neighbour conversation (the id with its lowest bit turned). Without an own or a
    neighbour's reply both sides are equal.
    """
    talks = gather_turns(turns)
    numbered = lambda name: F.filter(F.col(name), lambda t: t["role"] == TRAINED_ROLE)
    last = F.try_element_at(numbered("turns"), F.lit(-1))
    talks = talks.withColumn("last", last)
    replies = talks.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    joined = talks.join(replies, "conv_id", "left")
    upto = F.when(F.col("last").isNull(), F.col("turns")).otherwise(
        F.slice("turns", F.lit(1), F.array_position("turns", F.col("last")).cast("int"))
    )
    swap = lambda t: F.struct(
        t["unnumbered"].alias("unnumbered"),
        t["turn"].alias("turn"),
        t["role"].alias("role"),
        F.when(t == F.col("last"), F.coalesce("other", t["text"])).otherwise(t["text"]).alias("text"),
    )
    return joined.withColumn("chosen", upto).select("conv_id", "chosen", F.transform("chosen", swap).alias("rejected"))


def preference_query(spark, sf_dir: str) -> DataFrame:
    return format_preferences(reply_pairs(read(spark, sf_dir, "conversations")))


SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos FROM t
), last AS (
  SELECT conv_id, max(pos) AS last_pos, max_by(text, pos) AS reply FROM n WHERE role = 'assistant' GROUP BY conv_id
), p AS (
  SELECT n.conv_id, n.pos, n.role, n.text AS chosen,
         CASE WHEN n.pos = l.last_pos THEN coalesce(o.reply, n.text) ELSE n.text END AS rejected
  FROM n LEFT JOIN last l ON l.conv_id = n.conv_id LEFT JOIN last o ON o.conv_id = xor(n.conv_id, 1)
  WHERE l.conv_id IS NULL OR n.pos <= l.last_pos
), c AS (
  SELECT conv_id, coalesce(min(pos) FILTER (WHERE chosen <> rejected) - 1, max(pos)) AS n_common FROM p GROUP BY conv_id
), r AS (
  SELECT p.*, c.n_common, pos > n_common AS tail,
         '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || chosen || '<|end|>' || chr(10) AS ctext,
         '<|' || role || '|>' || chr(10) || rejected || '<|end|>' || chr(10) AS rtext
  FROM p JOIN c USING (conv_id)
), e AS (
  SELECT *, sum(CASE WHEN tail THEN length(ctext) ELSE 0 END) OVER w AS cend,
         sum(CASE WHEN tail THEN length(rtext) ELSE 0 END) OVER w AS rend
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, n_common,
  coalesce(string_agg(ctext, '' ORDER BY pos) FILTER (WHERE NOT tail), '') AS prompt,
  coalesce(string_agg(ctext, '' ORDER BY pos) FILTER (WHERE tail), '') AS chosen_completion,
  coalesce(string_agg((cend - length(ctext) + length(head)) || '-' || cend, ',' ORDER BY pos)
    FILTER (WHERE tail AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(rtext, '' ORDER BY pos) FILTER (WHERE tail), '') AS rejected_completion,
  coalesce(string_agg((rend - length(rtext) + length(head)) || '-' || rend, ',' ORDER BY pos)
    FILTER (WHERE tail AND role = 'assistant'), '') AS rejected_spans,
  coalesce(string_agg(ctext, '' ORDER BY pos) FILTER (WHERE tail), '')
    <> coalesce(string_agg(rtext, '' ORDER BY pos) FILTER (WHERE tail), '') AS has_preference
FROM e GROUP BY conv_id, n_common
"""
