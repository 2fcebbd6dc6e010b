"""Chat formatting by perspective rotation, with DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and
the others as named users. The rendering comes as one row per turn and perspective: its segment of
the dialogue and where in the segment the loss applies (the assistant's own text and end mark). The
segments in the order of turns are the dialogue; no conversation is gathered in one task, however long it is.

A null role is the participant `unknown`; a null text renders as empty; turns that repeat render again;
rows without a conversation id form no conversation and are left out. A `system` turn is an instruction, not a
participant: it stands in every rendering as the system's, without loss, and has no perspective of its own, so a
conversation of only such turns gives no rows. Turns with equal numbers stand in the order of speaker, then segment.
A text of any length is rendered inside its row. Only the four columns are read; others are not passed on.

A mark inside a text or a name can't open or close a turn: each `<|`, with or without backslashes between, gets one
more backslash (`<|` becomes `<\\|`), which can be undone; line breaks of a name become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
UNKNOWN, SYSTEM = "unknown", "system"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, segment, mask_start, mask_end) for turns (conv_id, turn,
    role, text). The mask is in code points of the segment, empty where another speaks."""
    speaker, body = F.coalesce(F.col("role"), F.lit(UNKNOWN)), escaped(F.coalesce(F.col("text"), F.lit("")))
    said = turns.where("conv_id is not null").select("conv_id", "turn", speaker.alias("speaker"), body.alias("body"))
    people = said.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    met = said.join(people, "conv_id")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.regexp_replace(escaped(F.col("speaker")), r"[\r\n]", " ")
    head = F.concat(F.lit(BEGIN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    tail = F.lit(f"{END}\n")
    begin = F.length(head)
    return met.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        role.alias("role"),
        F.concat(head, "body", tail).alias("segment"),
        begin.alias("mask_start"),
        F.when(own, begin + F.length("body") + len(END)).otherwise(begin).alias("mask_end"),
    )
