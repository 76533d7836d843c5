"""Chat formatting by rotating the perspective (operator 1).

A dialogue is rendered once for every participant: that speaker's turns become the assistant's and are marked for training,
the others' turns become those of users who go by their names, and system turns stay system turns for all. A rendering is
a table of segments, one for each turn, with the segment's place in the rendered dialogue and its mask: a dialogue of any
length is rendered by many tasks, since segments only need the sum of the lengths before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running

SYSTEM = "system"
#: Parts of a rendered turn: role, name of a user, text, end.
OPEN, NAMED, BODY, CLOSE = "<|", " name=", "|>\n", "<|end|>\n"
#: Parts that a conversation's turns are dealt into when they meet its participants.
SALTS = 32


def perspectives(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn and participant of its conversation.

    Columns: conversation, perspective (the participant), turn, speaker, role, name (of users), segment (the rendered turn),
    start and end (characters in the rendered dialogue), mask_start and mask_end (what is trained on: text and end mark of the
    perspective's own turns; otherwise both null). Turns go by number (null first), then speaker, then text. Null texts are
    empty. Null speakers are the participant `unknown`; a null conversation is a conversation. Repeated rows are turns of their
    own. Conversations of system turns alone have no participant and no rows.
    """
    rows = df.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    people = rows.where(F.col("speaker") != SYSTEM).select("conversation", "speaker").distinct()
    # The rendered length differs by perspective only in the head of a turn: long for users, who are named. So one running sum
    # of what all perspectives share, and one for the turns of each speaker, give every start. Whole texts are sorted once, and
    # then only meet the numbers of their own turn again.
    body: Column = F.length("text") + len(CLOSE)
    as_system = F.lit(len(OPEN + SYSTEM + BODY))
    as_user = F.lit(len(OPEN + "user" + NAMED + BODY)) + F.length("speaker")
    as_self = F.lit(len(OPEN + "assistant" + BODY))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    head = F.when(F.col("speaker") == SYSTEM, as_system).otherwise(as_user)
    shared = running(rows.withColumn("less", F.when(F.col("speaker") == SYSTEM, F.lit(0)).otherwise(as_user - as_self)), ["conversation"], order, head + body, "before")
    shared = cut(shared.select("conversation", "turn", "speaker", "text", "less", "before").withColumn("_id", F.monotonically_increasing_id()))
    # One conversation may hold any share of the turns: its participants go to every salt, its turns to one each.
    turns = shared.select("conversation", "speaker", "less", "before", "_id").withColumn("_salt", F.pmod(F.col("_id"), F.lit(SALTS)))
    sent = people.select(F.col("conversation").alias("_c"), F.col("speaker").alias("perspective"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_to"))
    sent = turns.join(sent, F.col("conversation").eqNullSafe(F.col("_c")) & (F.col("_salt") == F.col("_to"))).drop("_c", "_to", "_salt")
    # Earlier turns of the perspective itself are shorter by `less` than as a user's.
    own = F.col("speaker") == F.col("perspective")
    sent = running(sent, ["conversation", "perspective"], [F.col("before")], F.when(own, F.col("less")).otherwise(0), "saved")
    sent = sent.select("_id", "perspective", "saved").join(shared, "_id")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when((F.col("speaker") != SYSTEM) & ~own, F.col("speaker"))
    opening = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(NAMED), "name"), F.lit("")), F.lit(BODY))
    out = sent.withColumn("role", role).withColumn("name", name).withColumn("start", (F.col("before") - F.col("saved")).cast("long"))
    out = out.withColumn("segment", F.concat(opening, "text", F.lit(CLOSE))).withColumn("end", F.col("start") + F.length("segment"))
    mask = lambda c: F.when(own, c).cast("long")
    return out.select(
        F.col("conversation").alias(conversation), "perspective", F.col("turn").alias(turn), F.col("speaker").alias("speaker"), "role", "name", "segment", "start", F.col("end").cast("long").alias("end"),
        mask(F.col("end") - F.length("text") - len(CLOSE)).alias("mask_start"), mask(F.col("end") - 1).alias("mask_end"),
    )
