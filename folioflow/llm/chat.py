"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and written one block per run of adjacent turns of one role::

    <|im_start|>role\\n text <|im_sep|> text of the next turn of the same role <|im_end|>\\n

Texts cannot contain a control string: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, which :func:`parse_chats` takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import read

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a line end was written as one backslash and n; pairs of backslashes stand for one, so they are set aside first
    return F.concat_ws("\\", F.transform(F.split(role, r"\\\\", -1), lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, ``formatted`` and ``segments``, an array of (text, loss): joined, the segments' texts are ``formatted``,
    and ``loss`` marks those that a training loss covers (escaped texts of ``loss_role``, nothing around them).

    Null texts and roles count as empty, a null conv_id is a conversation of its own, turns sort by turn (null first), then
    role, then text; repeated rows are turns like any other. A conversation becomes one value, so one task must hold its text.
    No rows give no rows. Every expression is linear in a conversation's length.
    """
    cell = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get(F.col("t"), i).role != F.get(F.col("t"), i - 1).role))
    blocks = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.get(F.col("t"), s).role.alias("role"),
            F.slice(F.col("t.text"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("t")) - s).alias("texts"),
        ),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def written(block: Column) -> Column:
        texts = F.transform(
            block.texts,
            lambda text, i: F.array(
                segment(F.when(i == 0, F.concat(F.lit(START), escape_role(block.role), F.lit("\n"))).otherwise(SEP), F.lit(False)),
                segment(escape(text), block.role == loss_role),
            ),
        )
        return F.concat(F.flatten(texts), F.array(segment(F.lit(END), F.lit(False))))

    return (
        grouped.withColumn("starts", starts)
        .select("conv_id", F.flatten(F.transform(blocks, written)).alias("segments"))
        .select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")
    )


def parse_chats(formatted: Column) -> Column:
    """The turns that a formatted conversation was made of: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        line = F.instr(block, "\n")
        role = unescape_role(F.substr(block, F.lit(len(START) + 1), line - len(START) - 1))
        return F.transform(F.split(F.substr(block, line + 1), r"<\|im_sep\|>", -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, with figures that are read back from what was written."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = format_chats(turns.unionByName(probe)).withColumn("back", parse_chats(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "")
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w <> role, true) AS starts
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + CASE WHEN starts
    THEN 13 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 11 ELSE 10 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
