"""Chat formatting from event logs.

A log row is an event of a conversation: a whole message, a streamed delta, an
edit, a regeneration or a deletion.  Rows are brought together by conversation,
sorted by sequence and folded into the final messages, which are then rendered
with a template.  Only SQL functions are used.

Template: each message is ``<s>[ROLE]role[/ROLE]text</s>``.  ``&``, ``<`` and
``[`` in roles and texts are written ``&amp;``, ``&lt;`` and ``&#91;``, so no
control string can stand inside them and reading them back gives the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[ROLE]", "[/ROLE]", "</s>"
#: What a character is written as inside a role or text; the first is escaped first and read back last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))

MESSAGE, DELTA, EDIT, REGENERATE, DELETE = "message", "delta", "edit", "regenerate", "delete"


def escape(c: Column) -> Column:
    for raw, written in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, messages): the final messages of each conversation, in order.

    events: conv_id, seq, kind, target, role, text.  `target` names the message an
    event is about (any orderable value); messages stand in the order of `target`.
    message and regenerate start the text anew, delta appends, edit replaces the
    text, delete removes the message; a later message event brings it back.  Events
    are folded in the order of seq, ties by kind, role and text.  A null seq comes
    first, a null text is empty, a null role is the empty string, a null or unknown
    kind counts as message.  A message that has no event besides deltas is the
    deltas.  Rows with a null conv_id are one conversation.
    """
    kind = F.lower(F.coalesce("kind", F.lit(MESSAGE)))
    kind = F.when(kind.isin(DELTA, EDIT, REGENERATE, DELETE), kind).otherwise(F.lit(MESSAGE))
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "target").agg(F.array_sort(F.collect_list(event)).alias("log"))
    start = F.struct(F.lit(False).alias("live"), F.lit("").alias("role"), F.lit("").alias("text"))

    def step(acc: Column, e: Column) -> Column:
        again = e["kind"].isin(MESSAGE, REGENERATE, EDIT)
        return F.struct(
            (e["kind"] != DELETE).alias("live"),
            F.when((e["kind"] == MESSAGE) | (acc["role"] == ""), e["role"]).otherwise(acc["role"]).alias("role"),
            F.when(again | ~acc["live"], F.when(e["kind"] == DELETE, F.lit("")).otherwise(e["text"])).otherwise(F.concat(acc["text"], e["text"])).alias("text"),
        )

    last = logs.select("conv_id", "target", F.aggregate("log", start, step).alias("m"))
    message = F.when(F.col("m.live"), F.struct("target", F.col("m.role").alias("role"), F.col("m.text").alias("text")))
    folded = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("found"))
    return folded.select("conv_id", F.transform("found", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the formatted text and where the texts of role `learn` stand.

    loss_spans are structs (start, length) in code points, start counted from 0.
    A conversation without messages is an empty text without spans.
    """
    head = lambda m: F.concat(F.lit(BEGIN + OPEN), escape(m["role"]), F.lit(CLOSE))
    parts = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), head(m).alias("head"), escape(m["text"]).alias("body")))
    out = conversations.select("conv_id", parts.alias("parts"))
    text = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["head"])
        span = F.struct(body.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))
        return F.struct(
            (body + F.length(p["body"]) + len(END)).cast("long").alias("at"),
            F.when(p["role"] == learn, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return out.select("conv_id", text.alias("formatted"), F.aggregate("parts", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The messages (role, text) of a formatted text."""
    turns = F.filter(F.split(formatted, END), lambda t: t != "")
    role = lambda t: F.substring_index(F.substring(t, len(BEGIN + OPEN) + 1, 2**31 - 1), CLOSE, 1)
    return F.transform(turns, lambda t: F.struct(unescape(role(t)).alias("role"), unescape(F.substring(t, len(BEGIN + OPEN + CLOSE) + 1 + F.length(role(t)), F.length(t))).alias("text")))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, one entry for each span."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
