"""Chat formatting by prefix-target expansion, all in DataFrame functions.

Every assistant turn becomes one example: all turns before it as context, and only that reply under the loss
mask. Turns after the last assistant turn (or a conversation without one) give one more example with an empty
mask, so that no turn is lost. The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Control strings inside roles and texts are escaped so that the output can be read back: a backslash is doubled,
then ``<|`` becomes ``<\\|`` (and, in roles, a line feed ``<\\/``). An escaped text holds no ``<|``; a single
backslash between ``<`` and ``|`` occurs only where the escape put it.

Defined results: null roles and texts count as empty; turns sort by (turn, role, text), a null turn first, and
repeated rows stay repeated; rows with a null conv_id form one conversation; other columns are ignored; an
empty table gives no examples. One conversation is one row by contract, so its turns must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import read_table

START, END = "<|im_start|>", "<|im_end|>"
PROBE = f"{END}{START}assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def render(turn: Column) -> Column:
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(f"{END}\n"))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, example, formatted, loss_start, loss_end): one row per training example.

    ``example`` is the number of turns in it; [loss_start, loss_end) are code points of ``formatted``.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n))
    each = whole.select("conv_id", n.alias("n_turns"), F.transform("turns", render).alias("rendered"), F.transform("turns", lambda t: t["role"]).alias("roles"), F.explode(ends).alias("example"))
    formatted = F.concat_ws("", F.slice("rendered", F.lit(1), F.col("example")))
    made = each.select("conv_id", "n_turns", "example", formatted.alias("formatted"), F.length(F.element_at("rendered", F.col("example"))).alias("tail"), (F.element_at("roles", F.col("example")) == "assistant").alias("trained"))
    end = F.length("formatted") - F.when(F.col("trained"), len(END) + 1).otherwise(0)
    start = F.when(F.col("trained"), F.length("formatted") - F.col("tail") + len(f"{START}assistant\n")).otherwise(end)
    return made.select("conv_id", "n_turns", "example", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Conversations as the formatted examples hold them: turns from the last example, trained text from each mask."""
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    by_conv = examples.groupBy("conv_id").agg(
        F.max(F.when(F.col("example") == F.col("n_turns"), F.col("formatted"))).alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", unescape(masked).alias("text")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    pieces = F.slice(F.split("whole", r"<\|im_start\|>", -1), F.lit(2), F.size(F.split("whole", r"<\|im_start\|>", -1)))
    turn = lambda p: F.concat(
        unescape_role(F.substring_index(p, "\n", 1)), F.lit("\n"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)), F.lit("\n")
    )
    read = by_conv.select("conv_id", F.transform(pieces, turn).alias("turns"), F.concat_ws("", F.transform("losses", lambda x: x["text"])).alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", "turns"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return read_back(prefix_targets(conversations.unionByName(probe.withColumn("text", F.lit(PROBE)))))


OP1_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\/')) + 24) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
