"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as ``assistant``, everyone else as a named ``user``, and a mask that
holds the spans to train on (the speaker's texts with their closing marks).

Long conversations come in parts of ``part_turns`` turn numbers, so that no row
grows with the conversation; the parts of a perspective, in order, are its whole
dialogue.  Offsets in ``mask`` are code points within the part, end exclusive.

Defined results
* participants are the roles that are not null and not ``system``; ``system``
  messages appear as ``system`` in every perspective and are never masked;
* a null role speaks as ``unknown`` and is no participant; null text is empty;
* a null turn belongs to a part of its own (null); messages of one turn stand in
  the order of role, then text;
* repeated rows (same conversation, turn, role and text) are one message, unless
  ``keep_repeats``: then each row is a message of its own;
* a null conv_id is a conversation like any other; empty table: empty result;
  a conversation of system messages only has no perspective; extra columns are
  ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM = "system"


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS, keep_repeats: bool = False) -> DataFrame:
    """(conv_id, speaker, part, n_messages, n_targets, dialogue, mask).

    ``keep_repeats`` is for logs without turn numbers, or with shared ones."""
    messages = turns.select(
        "conv_id", "turn", F.expr(f"turn div {int(part_turns)}").alias("part"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNull().alias("nameless"))
    if not keep_repeats:
        messages = messages.distinct()
    speakers = (messages.where(~F.col("nameless") & (F.col("role") != SYSTEM))
                .select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct())
    parts = messages.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "nameless"))).alias("m"))
    own = lambda x: (x["role"] == F.col("speaker")) & ~x["nameless"]
    head = lambda x: (F.when(own(x), F.lit("<|im_start|>assistant\n"))
                      .when((x["role"] == SYSTEM) & ~x["nameless"], F.lit("<|im_start|>system\n"))
                      .otherwise(F.concat(F.lit("<|im_start|>user name="), x["role"], F.lit("\n"))))
    drawn = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["c"])).drop("c").withColumn(
        "seg", F.transform("m", lambda x: F.struct(head(x).alias("head"), x["text"].alias("text"), own(x).alias("own"))))
    end, tail = "<|im_end|>", "\n"
    start = lambda s, x: s["at"] + F.length(x["head"])
    stop = lambda s, x: start(s, x) + F.length(x["text"]) + len(end)
    walked = F.aggregate(
        "seg", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("mask")),
        lambda s, x: F.struct(
            (stop(s, x) + len(tail)).cast("bigint").alias("at"),
            F.when(x["own"], F.concat(s["mask"], F.when(s["mask"] == "", "").otherwise(","), start(s, x).cast("string"),
                                      F.lit(":"), stop(s, x).cast("string"))).otherwise(s["mask"]).alias("mask")))
    return drawn.select(
        "conv_id", "speaker", "part", F.size("m").cast("bigint").alias("n_messages"),
        F.size(F.filter("seg", lambda x: x["own"])).cast("bigint").alias("n_targets"),
        F.array_join(F.transform("seg", lambda x: F.concat(x["head"], x["text"], F.lit(end + tail))), "").alias("dialogue"),
        walked["mask"].alias("mask"))
