"""Chat formatting with relational operators.

A conversation's turns are collected as structs and sorted, all in one row.  The places where the
role changes cut the array into blocks of neighbouring turns of one role; each block's turns are
merged, and the blocks are concatenated.  A block is
``<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n``; the separator stands between merged
turns, so the turns can be read back.  The result is an array of segments, each with a loss flag:
``formatted`` is their concatenation and the loss mask covers just the assistants' texts.

Merging is by array functions whose time grows with the turns.  A fold by ``aggregate`` is not used:
it copies what it has merged so far at every turn.

Inside texts ``<|`` gets a backslash after ``<`` (and ``<\\|`` one more, and so on), so no text
can hold a control string; roles are escaped by percent signs, which also covers line ends.
Both are undone on reading.  Spark expressions only.

Defined cases: a null text or role is empty; turns of equal number are in the order of role, then
text; repeated rows are turns of their own; a null conv_id is a conversation; null turn numbers
come first; an empty table gives no conversations; other columns are ignored.  Very long texts are
formatted whole.  All turns of a conversation are one row of one task, so a conversation must fit
a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _blocks(turns: Column) -> Column:
    """Sorted turns cut into arrays of neighbours of one role."""
    first = F.filter(
        F.transform(turns, lambda t, k: F.when(~t["role"].eqNullSafe(F.get(turns, k - 1)["role"]) | (k == 0), k)), lambda k: k.isNotNull()
    )
    return let(first, lambda at: F.transform(at, lambda k, i: F.slice(turns, k + 1, F.coalesce(F.get(at, i + 1), F.size(turns)) - k)))


def _segment(text: Column, loss: Column | bool = False) -> Column:
    return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def _segments(block: Column) -> Column:
    """A block's segments: its opening, its texts with separators between them, its end."""
    role = F.get(block, F.lit(0))["role"]
    opening = F.array(_segment(F.concat(F.lit(START), escape_role(role), F.lit("\n"))))

    def merged(t: Column, k: Column) -> Column:
        own = F.array(_segment(escape(t["text"]), t["role"] == TRAINED_ROLE))
        return F.when(k == 0, own).otherwise(F.concat(F.array(_segment(F.lit(SEPARATOR))), own))

    return F.concat(opening, F.flatten(F.transform(block, merged)), F.array(_segment(F.lit(END + "\n"))))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments (array of text and loss), formatted; one row for each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = ordered.select("conv_id", F.flatten(F.transform(_blocks(F.col("turns")), _segments)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def of(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.regexp_extract(block, r"(?s)\A[^\n]*\n(.*)<\|im_end\|>\n\z", 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def own_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    told = END + START + "assistant ok"
    return spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own_conversation(spark))
    chats = format_chats(turns).select("conv_id", "formatted", trained_text(F.col("segments")).alias("trained"), read_turns(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL AS goes_on
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN goes_on THEN 10 ELSE 12 + 1 + 11 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|')) END
           + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
