"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log has events (conversation, sequence, turn, kind, role, text). ``message`` and ``edit`` set a turn's text, ``delta``
appends to it, and ``regenerate`` takes back the turn and all later ones as far as they were logged before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks (role: opening, closing), and the opening parts of turns with any other role.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
OTHER = ("[ROLE] ", " [MSG] ", " [/MSG]")
#: Control strings that texts may not hold unescaped. All begin with < or [, which none holds elsewhere.
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[MSG]", "[/MSG]")
_REST = "|".join(x[1:].replace("]", "\\]") for x in CONTROLS)


def escape(text: Column) -> Column:
    """Double each backslash and put one behind the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, "\\\\", "\\\\\\\\"), f"([<\\[])(?={_REST})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\([\\s\\S])", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Groups are one turn each; a conversation's regenerations are few and meet the events by a join. Events with equal seq
    are taken by kind, then text. Null text is empty, null kind is ``message``, the role is the last one that isn't null.
    A turn of which nothing is left has no message. Null conversations and turns are groups of their own.
    """
    e = events.select(
        "conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    back = (
        e.where("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("seq"))
        .groupBy("conv_id").agg(F.collect_list(F.struct("turn", "seq")).alias("back"))  # a row for each turn at most
        .select(F.col("conv_id").alias("b_conv"), "back")
    )
    gone = F.exists(F.coalesce("back", F.array()), lambda b: (b["turn"] <= F.col("turn")) & (b["seq"] > F.col("seq")))
    alive = e.join(back, F.col("conv_id").eqNullSafe(F.col("b_conv")), "left").where(F.coalesce(~gone, F.lit(True))).where("kind <> 'regenerate'")
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    turns = alive.groupBy("conv_id", "turn").agg(log.alias("log"))
    resets = F.filter(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i)), lambda i: i.isNotNull())
    since = F.greatest(F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.lit(1))
    said = F.slice("log", since, F.size("log"))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return turns.select(
        "conv_id", "turn", F.try_element_at(roles, F.lit(-1)).alias("role"),
        F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, and segments, whose texts joined are ``formatted``.

    ``segments``: array of (text, loss); loss is true for assistants' texts alone. Messages come by turn, null first; those
    that share a turn by role and text. Control strings and backslashes in texts and other roles' names are escaped; a
    null role is an empty name. A conversation is one string in the end, but its messages are escaped before they meet.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    parts = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    head = F.when(role == "system", MARKS["system"][0]).when(role == "user", MARKS["user"][0]).when(role == "assistant", MARKS["assistant"][0]).otherwise(parts)
    tail = F.when(role == "system", MARKS["system"][1]).when(role == "user", MARKS["user"][1]).when(role == "assistant", MARKS["assistant"][1]).otherwise(F.lit(OTHER[2]))
    each = messages.select("conv_id", "turn", role.alias("role"), head.alias("head"), text.alias("body"), tail.alias("tail"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "tail"))).alias("m"))
    pieces = F.flatten(
        F.transform(
            "m",
            lambda m: F.array(
                F.struct(m["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(m["body"].alias("text"), (m["role"] == "assistant").alias("loss")),
                F.struct(m["tail"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return whole.select("conv_id", pieces.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of (role, text)."""
    turn = "(?:\\[(?:SYS|INST|OUT)\\]|\\[ROLE\\][\\s\\S]*?\\[MSG\\]) [\\s\\S]*? (?:\\[/(?:SYS|INST|MSG)\\]|</s>)"

    def parse(x: Column) -> Column:
        mark = F.regexp_extract(x, "^\\[([A-Z]+)\\]", 1)
        role = (
            F.when(mark == "SYS", "system").when(mark == "INST", "user").when(mark == "OUT", "assistant")
            .otherwise(unescape(F.regexp_extract(x, "^\\[ROLE\\] ([\\s\\S]*?) \\[MSG\\] ", 1)))
        )
        body = F.regexp_extract(x, "^(?:\\[(?:SYS|INST|OUT)\\]|\\[ROLE\\][\\s\\S]*?\\[MSG\\]) ([\\s\\S]*) (?:\\[/(?:SYS|INST|MSG)\\]|</s>)$", 1)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(0)), parse)


def format_chats(events: DataFrame) -> DataFrame:
    """Fold a log into messages and render each conversation: conv_id, formatted, segments. No events give no rows."""
    return render(fold_events(events))
