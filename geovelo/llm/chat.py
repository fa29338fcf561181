"""Chat formatting: logs of chat events folded into final messages, rendered with control strings escaped and a loss mask.

All of it is DataFrame functions: one exchange on the conversation, windows and sorted folds behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, BODY, CLOSE = "<|start|>", "<|message|>", "<|end|>"
#: Each of these characters is followed by a backslash when it stands in a text, so neither the template's marks nor strings
#: such as </s> or [INST] can occur in what a text turns into; dropping that backslash restores the text.
_GUARDED = r"([<\[\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _GUARDED, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _GUARDED + r"\\", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of an event log.

    events: conv_id, seq, kind, turn, role, text. A conversation's events count in the order of seq:
    'message' sets a turn's text, 'edit' replaces it, 'delta' appends to it, and 'regenerate' starts the turn anew, with
    its own text if it has any, and drops that turn and all later turns as they stood. A turn's role is the last one
    given. Null texts count as empty. Events of one seq count in the order message, regenerate, edit, delta, then by text;
    a null seq or turn comes first; an unknown kind counts as a message; a repeated message or edit changes
    nothing, a repeated delta appends again. A turn that only has deltas is their concatenation.
    Null conv_ids are one conversation. An empty log has no messages.
    """
    rank = F.when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).when(F.col("kind") == "delta", 3).otherwise(0)
    base = events.select("conv_id", F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("at"), F.coalesce("turn", F.lit(-(1 << 62))).alias("slot"), "turn", "role", F.coalesce("kind", F.lit("message")).alias("kind"))
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    redone = F.min(F.when(F.col("kind") == "regenerate", F.col("slot"))).over(later)
    alive = base.withColumn("redone", redone).where("redone IS NULL OR redone > slot")
    # texts before the last event that sets a turn no longer count
    last_set = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(Window.partitionBy("conv_id", "slot"))
    standing = alive.withColumn("set", last_set).where("set IS NULL OR at >= set")
    parts = F.array_sort(F.collect_list(F.struct("at", "role")))
    folded = standing.groupBy("conv_id", "slot").agg(F.first("turn").alias("turn"), parts.alias("parts"))
    role = F.element_at(F.filter("parts", lambda x: x["role"].isNotNull())["role"], -1)
    return folded.select("conv_id", "turn", F.when(F.exists("parts", lambda x: x["role"].isNotNull()), role).alias("role"), F.array_join(F.col("parts")["at"]["text"], "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments) with one row a conversation.

    messages: conv_id, turn, role, text. formatted is the string to train on; segments cuts it into (text, loss) pieces in
    order, loss being true exactly on the texts of the roles in learn. Null roles and texts are empty; turns are ordered by turn (null first), role and text,
    repeated rows being turns of their own; null conv_ids are one conversation; an empty table gives an empty result; other columns are ignored.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(BODY))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("loss"))
    told = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    cut = F.flatten(F.transform("turns", lambda t: F.array(piece(t["head"], F.lit(False)), piece(t["body"], t["loss"]), piece(F.lit(CLOSE), F.lit(False)))))
    return told.select("conv_id", cut.alias("segments")).select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """array of (role, text), read back from a formatted string."""
    turns = F.filter(F.split(formatted, CLOSE.replace("|", r"\|")), lambda x: x != "")
    body = lambda x: F.instr(x, BODY)
    return F.transform(turns, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), body(x) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, body(x) + len(BODY), F.length(x))).alias("text"),
    ))


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table with one row a turn as a log: each row is a message of its own. Rows of one turn number stay apart, in the order of role and text, nulls first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("turn"))
    return numbered.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def format_chats(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): an event log folded and rendered; odd rows as fold() and render() define them, very long texts whole."""
    return render(fold(events), learn)
