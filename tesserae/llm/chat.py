"""Chat formatting from event logs, in DataFrame operations only.

A log row is an event: ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate``
discards it so that later deltas build it anew. Logs are partitioned by conversation and sorted by sequence; each
``message`` opens the next message, later events of the conversation belong to it unless they name another one in
``target``. A message's final text is the text of its last opening, edit or regeneration followed by all later deltas.

The rendered form is ``<s>[role]text</s>`` for each turn. Inside roles and texts the characters ``\\ < [ ]`` become
``\\s \\l \\b \\r``, so no control string can occur there, and the change is undone exactly.

Cases: null text and null role are empty; rows of equal sequence are ordered by role, then text, and all count; a
conversation with a null id is a conversation of its own; deltas before any message open one; an empty table gives an
empty table. A conversation's final messages are gathered in one row, for its digest is of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that never appear inside a rendered role or text, and their escapes. The backslash is first.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))
OPEN, MID, CLOSE = "<s>[", "]", "</s>"
#: Roles whose texts carry loss.
LOSS_ROLES = ("assistant",)


def escape(c: Column) -> Column:
    for char, code in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for char, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, seq, op, role, text[, target]) into final messages: conv_id, msg, role, text."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    target = F.col("target") if "target" in events.columns else F.lit(None).cast("long")
    rows = events.select("conv_id", "seq", F.coalesce(F.col("op"), F.lit("message")).alias("op"), role.alias("role"), text.alias("text"), target.cast("long").alias("target"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "op")
    rows = rows.withColumn("at", F.row_number().over(order))
    opened = F.sum((F.col("op") == "message").cast("long")).over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("msg", F.coalesce(F.col("target"), F.greatest(opened, F.lit(1)) - 1))
    event = F.struct("at", "op", "role", "text")
    folded = rows.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(event)).alias("log"))
    reset = F.array_max(F.transform(F.filter("log", lambda e: e.op != "delta"), lambda e: e.at))
    folded = folded.withColumn("reset", F.coalesce(reset, F.lit(0)))
    # The opening, edit or regeneration itself begins the text; a regeneration's own text is what it starts with.
    final = F.array_join(F.transform(F.filter("log", lambda e: e.at >= F.col("reset")), lambda e: e.text), "")
    return folded.select("conv_id", "msg", F.col("log")[0].role.alias("role"), final.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and the formatted text."""
    turn = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(CLOSE))
    turns = messages.select("conv_id", F.struct("msg", turn.alias("t")).alias("turn"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return gathered.select("conv_id", F.array_join(F.transform("turns", lambda t: t.t), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The rendered text taken apart again: adds ``turns``, an array of (role, text)."""
    parts = F.split(F.col("formatted"), CLOSE, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p):
        cut = F.locate(MID, p)
        body = F.substring(p, cut + 1, F.length(p))
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(body).alias("text"))

    return formatted.withColumn("turns", F.transform(parts, turn))


def digests(read: DataFrame, loss_roles=LOSS_ROLES) -> DataFrame:
    """What was read back, as counts and SHA-256 digests."""
    every = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.role.isin(*loss_roles)), lambda t: t.text), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), each a whole message, to formatted conversations."""
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), "role", "text")
    return render(reconstruct(events))


def streamed(rows: DataFrame) -> DataFrame:
    """An event log whose folding gives the messages (conv_id, turn, role, text) again, as a service that streams would write it.

    Messages of the loss roles open with a draft that a regeneration discards, every third other message is edited, and all
    others open with half of their text; what is left comes as deltas. Rows of equal turn are ordered by role, then text.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("place", place.cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def log(*events):
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), said.alias("said")) for k, (op, said) in enumerate(events)])

    draft = log(("message", F.concat(F.lit("draft "), head)), ("regenerate", F.lit("")), ("delta", head), ("delta", rest))
    edited = log(("message", rest), ("delta", head), ("edit", F.col("text")))
    plain = log(("message", head), ("delta", rest))
    events = F.when(F.col("role").isin(*LOSS_ROLES), draft).when(F.col("place") % 3 == 0, edited).otherwise(plain)
    events = rows.select("conv_id", "place", "role", F.explode(events).alias("e"))
    named = F.when(F.col("e.op") == "message", F.col("role"))
    return events.select("conv_id", (F.col("place") * 4 + F.col("e.k")).alias("seq"), "e.op", named.alias("role"), F.col("e.said").alias("text"))
