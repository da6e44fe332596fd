"""Chat formatting from an event log (operator 8), in DataFrame functions only.

The log is partitioned by conversation and sorted by sequence. A `message` event (or one without a kind) opens a message, `delta`
appends to the open one, `edit` replaces its text, `regenerate` drops what it had and starts again. A running count of openings
names the message, a running count of resets the version; only a message's last version counts, its texts joined in order. Then
every message is rendered, and the loss mask marks where the answers' texts lie in the rendered string.

Template: [INST]role[/INST]text</s> for each turn. In roles and texts a backslash is doubled and every control string gets one
after its first character, so none survives, and taking one backslash from before any character restores the text.

A conversation is one string in the end, so its events meet in one task; conversations are independent.

Defined results: null texts and roles are empty; rows equal in conversation and sequence are separate events, ordered by role, then
text; events before the first message form a message with the first one's role; a null conv_id is a conversation; an empty log
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Control strings of this template and of its relatives.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL_RX = r"(<(?=s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)|\[(?=INST\]|/INST\]))"
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RX, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text from events (conv_id, seq, kind, role, text)."""
    kind = F.coalesce("kind", F.lit("message"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    opens, resets = kind == "message", kind.isin("message", "edit", "regenerate")
    numbered = events.select(
        "conv_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.row_number().over(order).alias("at"),
        F.sum(opens.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("message"),
        F.sum(resets.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("version"),
    )
    versions = numbered.groupBy("conv_id", "message", "version").agg(F.min(F.struct("at", "role")).alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("text"))
    return versions.groupBy("conv_id", "message").agg(F.min("head").alias("head"), F.max_by("text", "version").alias("text")).select("conv_id", "message", F.col("head.role").alias("role"), "text")


def render(messages: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, end>> (code points, end exclusive)."""
    head = F.concat(F.lit("[INST]"), escape(F.col("role")), F.lit("[/INST]"))
    pieces = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    length = F.char_length("head") + F.char_length("body") + len("</s>")
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("from", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.char_length("head"))
    span = F.struct(F.col("from").cast("int").alias("start"), (F.col("from") + F.char_length("body")).cast("int").alias("end"))
    turn = F.struct("message", F.concat("head", "body", F.lit("</s>")).alias("piece"), F.when(F.col("role").isin(*trained), span).alias("span"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a rendered string."""
    turns = F.slice(F.split(formatted, "</s>", -1), 1, F.size(F.split(formatted, "</s>", -1)) - 1)

    def one(turn: Column) -> Column:
        cut = F.instr(turn, "[/INST]")
        size = F.char_length(turn)
        return F.struct(unescape(turn.substr(F.lit(len("[INST]") + 1), cut - len("[INST]") - 1)).alias("role"), unescape(turn.substr(cut + len("[/INST]"), size)).alias("text"))

    return F.transform(turns, one)


def events_of(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table as a log of messages, with conversation -1, whose texts are control strings."""
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from what render() gives."""
    rendered = render(fold(events_of(spark, conversations)))
    under = F.transform("loss_mask", lambda m: unescape(F.col("formatted").substr(m["start"] + 1, m["end"] - m["start"])))
    read = rendered.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: Escaping adds one character for each backslash and each control string.
_EXTRA = r"len(regexp_extract_all({0}, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'))"
SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + {len("[INST][/INST]</s>")} + {_EXTRA.format("role")} + {_EXTRA.format("text")})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
