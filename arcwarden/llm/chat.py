"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into a block, which holds the
role and the array of its texts, cut from the sorted array between the places where the role changes. The template of a block:

    <|turn|>role<|text|>first text<|next|>second text<|end|>

Roles and texts are escaped, so that no control string (all start with ``<|``) can stand inside them: a backslash is doubled
and ``<|`` becomes ``<\\|``. The loss mask comes as run lengths over the formatted string, two for each control string: the
control string itself, and what stands between it and the next one, which is under the mask for assistant texts only. Merging
and both of these are linear in the conversation's length; the bounds inside a block are kept, so that turns can be read back.

Edge cases: null texts and roles are empty strings; turns without a number come first; equal numbers are ordered by role and
text; repeated rows are turns of their own; rows without a ``conv_id`` form one conversation without an id. An empty table
gives an empty result. A conversation becomes one string, so one of billions of turns can't be formatted by any design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def merged_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, blocks)``: the conversation's adjacent turns of one role as ``struct<role, texts array>``, escaped, in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collected = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i - 1) != role(i)))
    length = lambda i, k: F.coalesce(F.get("starts", k + 1), F.size("turns")) - i
    texts = lambda i, k: F.transform(F.slice("turns", i + 1, length(i, k)), lambda t: escape(t["text"]))
    blocks = F.transform("starts", lambda i, k: F.struct(role(i).alias("role"), escape(role(i)).alias("said"), texts(i, k).alias("texts")))
    return collected.withColumn("starts", starts).select("conv_id", blocks.alias("blocks"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)`` of ``turns(conv_id, turn, role, text)``."""
    string = lambda b: F.concat(F.lit(TURN), b["said"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))
    run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    no, marker = F.lit(False), lambda m: run(F.lit(len(m)), F.lit(False))
    own = lambda b, t: run(F.length(t), b["role"] == ASSISTANT)
    inner = lambda b: F.flatten(F.transform(b["texts"], lambda t, i: F.when(i == 0, F.array(own(b, t))).otherwise(F.array(marker(NEXT), own(b, t)))))
    runs = lambda b: F.concat(F.array(marker(TURN), run(F.length(b["said"]), no), marker(TEXT)), inner(b), F.array(marker(END), run(F.lit(0), no)))
    return merged_turns(turns).select("conv_id", F.array_join(F.transform("blocks", string), "").alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(F.substring(b, len(TURN) + 1, 1 << 30), TEXT, 1))
    body = lambda b: F.substring(b, F.instr(b, TEXT) + len(TEXT), F.lit(1 << 30))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|next\|>"), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    pieces = F.split(formatted, r"(?=<\|)")  # each control string and what follows it
    under = lambda p, i: F.when(F.get(mask, 2 * i + 1)["loss"], unescape(F.substring(p, F.get(mask, 2 * i)["chars"] + 1, F.get(mask, 2 * i + 1)["chars"]))).otherwise(F.lit(""))
    return F.array_join(F.transform(pieces, under), "")


#: The conversation whose texts are control strings of another template.
PLANTED = "-7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op8_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = format_chats(turns.unionByName(spark.sql(f"SELECT {PLANTED}")))
    read = done.withColumns({"turns": read_turns(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_mask"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), around AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER o AS starts, replace(replace(text, '\', '\\'), '<|', '<\|') AS esc,
    replace(replace(role, '\', '\\'), '<|', '<\|') AS erole
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN starts THEN 16 + length(erole) + 7 ELSE 8 END)::BIGINT AS formatted_chars
FROM around GROUP BY conv_id
"""
