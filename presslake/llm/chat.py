"""Chat formatting from event logs: deltas, edits and regenerations fold into final messages, which a template renders.

A log holds rows (conv_id, seq, kind, turn, role, text) in any order. It is partitioned by conversation once; windows over
(conversation, turn) find what each event still says, and the pieces of a conversation meet only as what is left to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.common import let

#: What may happen to a turn: a whole message, text added to it, its text replaced, or it is begun again.
KINDS = ("message", "delta", "edit", "regenerate")
# Strings that steer a model and must not stand in a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: First character of each control string, where one stands.
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)"
#: What stands before and after the text of a turn; other roles are named inside the mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": (" ", " </s>")}
OTHER = ("<s>", "\n", " </s>")
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>\n.*?\n<</SYS>>|<s>.*? </s>| .*? </s>"
#: Stands for a null place; turns and seq are above it.
_FIRST = 1 - 2**63


def escape(text: Column) -> Column:
    """`text` without control strings: a backslash goes before each backslash and behind the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(role: Column, text: Column) -> Column:
    """A turn between its marks."""
    name = F.regexp_replace(escape(role), "\n", "\\\\\n")
    out = F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1]), escape(text), F.lit(OTHER[2]))
    for known, (before, after) in MARKS.items():
        out = F.when(role == known, F.concat(F.lit(before), escape(text), F.lit(after))).otherwise(out)
    return out


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, at, role, text): the final messages of logs of (conv_id, seq, kind, turn, role, text).

    In order of `seq`, `message` and `edit` set the text of a turn, `delta` adds to it, and `regenerate` empties it and drops every
    later turn that was spoken before. A turn is told by its last message, edit or regeneration and the deltas from there on; one that a
    regeneration drops stays dropped, deltas that still arrive included, until it is set again. The role is the last one named.

    Null kinds are messages, other kinds are ignored. Null text is empty, a role that no event names is empty, null seq comes first,
    null turns are one turn before the others, and rows without conv_id are one conversation. Messages of
    one turn with equal seq are a message each, in the order of role and text (`at`), repeated rows included; deltas belong to the last of
    them. A turn that only a regeneration is left of is not there. Other columns are not read.
    """
    kind, seq = F.coalesce("kind", F.lit("message")), F.coalesce(F.col("seq").cast("long"), F.lit(_FIRST))
    log = events.select("conv_id", F.col("turn").cast("long").alias("turn"), seq.alias("seq"), kind.alias("kind"), "role",
                        F.coalesce("text", F.lit("")).alias("text")).where(F.col("kind").isin(*KINDS))
    own = Window.partitionBy("conv_id", "turn")
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    # Turns as places without null, for the range of the window that ends before the own turn.
    log = log.withColumn("turn", F.coalesce("turn", F.lit(_FIRST)))
    told = log.select(
        "*", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(own).alias("set_at"), F.min("seq").over(own).alias("begun_at"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(own).alias("last_role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(before).alias("cut_at"))
    base = F.coalesce("set_at", "begun_at")
    left = told.where((F.col("seq") >= base) & (F.col("kind") != "regenerate") & (F.col("cut_at").isNull() | (base > F.col("cut_at"))))
    whole = F.col("kind").isin("message", "edit")
    rank = F.row_number().over(own.orderBy(F.when(whole, 0).otherwise(1), F.coalesce("seq", F.lit(_FIRST)), F.coalesce("role", F.lit("")), "text"))
    bases = F.count(F.when(whole, 1)).over(own)
    numbered = left.withColumn("rank", rank).withColumn("bases", bases)
    # Whole messages stand alone; what was added goes to the last of them.
    numbered = numbered.withColumn("at", F.least(F.col("rank"), F.greatest(F.col("bases"), F.lit(1))).cast("int") - 1)
    role = F.when(F.col("bases") > 1, F.coalesce("role", "last_role")).otherwise(F.col("last_role"))
    parts = numbered.withColumn("role", F.coalesce(role, F.lit(""))).groupBy("conv_id", "turn", "at").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("parts"), F.min_by("role", "rank").alias("role"))
    turn = F.when(F.col("turn") != _FIRST, F.col("turn"))
    return parts.select("conv_id", turn.alias("turn"), "at", "role", F.array_join("parts.text", "").alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, loss_spans (array of [start, end) in code points of `formatted`).

    Messages are those of `messages`, in order of turn. Texts are escaped, so that only the template writes control strings; loss
    spans hold the texts of assistant turns between their marks. `read_back` gives the turns again. A conversation
    whose turns are all dropped, and an empty log, give no row. The text of a conversation is one value, as its formatted string is.
    """
    pieces = messages(events).select("conv_id", F.coalesce("turn", F.lit(_FIRST)).alias("turn"), "at", "role", _rendered(F.col("role"), F.col("text")).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "at")
    size = F.length("piece").cast("long")
    placed = pieces.withColumn("end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before, after = (F.lit(len(x)) for x in MARKS["assistant"])
    span = F.struct((F.col("end") - size + before).alias("start"), (F.col("end") - after).alias("end"))
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "at", "piece"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"))
    return gathered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted string, unescaped."""
    def turn(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"(?s)^<s>((?:\\.|[^\\\n])*+)\n", 1)
        out = F.struct(unescape(name).alias("role"), unescape(F.substring(
            piece, F.length(name) + len(OTHER[0] + OTHER[1]) + 1, F.length(piece) - F.length(name) - len("".join(OTHER)))).alias("text"))
        for role, (before, after) in MARKS.items():
            text = F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))
            out = F.when(piece.startswith(before), F.struct(F.lit(role).alias("role"), unescape(text).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def digests(chats: DataFrame) -> DataFrame:
    """Of `format_chats`, read back from the formatted strings: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss text is what stands in the loss spans of the formatted string, unescaped.
    """
    turns = F.concat(F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"])), "\n"), F.lit("\n"))
    told = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.transform("loss_spans", lambda s: F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))).alias("masked"))
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       let(F.array_join(F.transform("masked", unescape), ""), lambda t: F.struct(
                           F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha256"))).alias("loss"),
                       F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.col("loss.n").alias("loss_chars"), F.col("loss.sha256").alias("loss_sha256"), "formatted_chars")
