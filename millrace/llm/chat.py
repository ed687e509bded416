"""Chat formatting by event-sourced reconstruction, on DataFrame functions alone.

A log holds one row per event of a conversation. It is partitioned by conversation and sorted by sequence; the
events that still count are folded into messages, and the messages into one formatted text:

=============  ==============================================================================
kind           effect on the message with number ``message``
=============  ==============================================================================
``open``       starts it with ``role``; text before it is dropped
``delta``      appends ``text``
``edit``       replaces the text so far by ``text``; ``role`` replaces the role if given
``regenerate`` drops its text so far and all later messages of the conversation
=============  ==============================================================================

A message is formatted as ``<|im_start|>role`` + line feed + text + ``<|im_end|>`` + line feed. Inside a text each ``<|``,
with any backslashes between its two characters, gets one more backslash, so no text contains a control string, and
removing one restores it. Roles are percent-encoded, which leaves plain names as they are. The loss mask lists the
byte ranges of assistant texts.

All events of a conversation meet in one task, since its formatted text is one value; the memory of a conversation is
bounded by that of its own text. The fold needs one shuffle.

Defined cases: null text and null role count as empty; a null conversation id is a conversation of its own; equal sequence
numbers are ordered by message, kind, role and text; repeated events count as often as they occur; unknown kinds are refused; empty logs give
no rows; other columns are not read. A message whose only events were dropped does not appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("open", "delta", "edit", "regenerate")
#: Characters of one streamed piece when a finished turn is written as a log.
DELTA_CHARS = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def log_of_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS, drafts: bool = False) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log: an ``open`` and the streamed pieces of each row.

    With ``drafts`` each turn is written twice. First comes a draft of it that no result may show: an assistant's draft is
    answered by a further message and then regenerated, any other's is replaced by an edit that carries the first piece.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "role", text.alias("text"), F.row_number().over(order).cast("long").alias("message"))
    # one pass over the text, whatever its length
    rows = rows.withColumn("pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)))

    def event(kind: str, text: Column | None = None, role: Column | None = None, ahead: int = 0) -> Column:
        role, text = (F.lit(None).cast("string") if c is None else c for c in (role, text))
        return F.struct(F.lit(kind).alias("kind"), F.lit(ahead).alias("ahead"), role.alias("role"), text.alias("text"))

    def streamed(pieces: Column) -> Column:
        return F.transform(pieces, lambda piece: event("delta", piece))

    events = F.concat(F.array(event("open", role=F.col("role"))), streamed(F.col("pieces")))
    if drafts:
        first = F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))
        draft = F.concat(F.lit("draft "), first)
        begun = [event("open", role=F.col("role")), event("delta", draft)]
        again = F.array(*begun, event("open", draft, F.lit("user"), ahead=1), event("regenerate"))
        edited = F.array(*begun, event("edit", first))
        rest = F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(0)))
        events = F.when(F.col("role") == "assistant", F.concat(again, streamed(F.col("pieces")))).otherwise(
            F.concat(edited, streamed(rest))
        )
    return rows.select("conv_id", "message", F.posexplode(events).alias("piece", "event")).select(
        "conv_id",
        (F.shiftleft("message", 32) + F.col("piece")).alias("seq"),
        "event.kind",
        (F.col("message") + F.col("event.ahead")).alias("message"),
        "event.role",
        "event.text",
    )


def fold(log: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, message, role, text."""
    events = log.select(
        "conv_id",
        "seq",
        F.when(F.col("kind").isin(*KINDS), F.col("kind"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown event "), F.coalesce("kind", F.lit("null")))))
        .alias("kind"),
        "message",
        "role",
        "text",
    )
    ordered = Window.partitionBy("conv_id").orderBy("seq", "message", "kind", "role", "text")
    events = events.withColumn("place", F.row_number().over(ordered))
    again = F.when(F.col("kind") == "regenerate", F.col("place"))
    restart = F.when(F.col("kind") != "delta", F.col("place"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "message")
    live = events.select(
        "*",
        F.coalesce(F.max(again).over(earlier), F.lit(0)).alias("dropped_until"),
        F.coalesce(F.max(restart).over(own), F.lit(0)).alias("restarted_at"),
    ).filter("place > dropped_until")
    # a dropped message leaves no role to the one that takes its number
    named = F.max(F.when(F.col("role").isNotNull(), F.struct("place", "role"))).over(own)
    live = live.withColumn("named", named).filter("place >= restarted_at")
    parts = F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text"))))
    return (
        live.groupBy("conv_id", "message")
        .agg(parts.alias("parts"), F.max("named.role").alias("role"))
        .select(
            "conv_id",
            "message",
            F.coalesce("role", F.lit("")).alias("role"),
            F.array_join("parts.text", "").alias("text"),
        )
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``, byte ranges of its UTF-8 form, end exclusive."""
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    pieces = messages.select(
        "conv_id", "message", F.col("role").isin(*loss_roles).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("size", (F.octet_length("head") + F.octet_length("body") + len(END) + 1).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn(
        "start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.octet_length("head")
    ).select(
        "conv_id",
        F.struct(
            "message",
            F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
            F.when(F.col("loss"), F.struct("start", (F.col("start") + F.octet_length("body")).alias("end"))).alias("span"),
        ).alias("piece"),
    )
    sorted_pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return sorted_pieces.select(
        "conv_id",
        F.array_join("pieces.segment", "").alias("formatted"),
        F.filter("pieces.span", lambda span: span.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of role and text."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>"), -1), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        size = F.length(piece) - F.length(role) - 1 - (len(END) + 1)
        return F.struct(
            F.url_decode(role).alias("role"), unescape(F.substring(piece, F.length(role) + 2, size)).alias("text")
        )

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, in order."""
    raw = formatted.cast("binary")
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")),
        ),
        "",
    )
