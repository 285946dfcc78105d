"""Multi-party perspective rotation of dialogues.

Every participant's view of a dialogue renders that speaker as the assistant, the others as named users and the
system's turns as they are; the mask covers what the participant says, end marker included. A dialogue may be
longer than any row should be, so a view is given in parts of at most ``part_turns`` turns. The parts in order,
laid end to end, are the view: ``offset`` says where each begins. Usual dialogues have one part.

The text moves once, to (conversation, part). Offsets come from sums of lengths, a row for each speaker and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
PART_TURNS = 256


def _head(name: Column, speaker: Column) -> Column:
    who = F.when(name == SYSTEM, SYSTEM).when(name == speaker, "assistant").otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS
) -> DataFrame:
    """conv_id, speaker, part, offset, n_turns, rendered, mask (array of start and end, code points in rendered).

    Turns are ordered by turn (null first), speaker, text; repeated rows stay. A null or blank speaker is
    'unknown', a null text is empty, a null conversation id is a conversation. A dialogue that only the system
    speaks in has no participant and so no view. ``<|`` inside a text or a name becomes ``< |``, so that no text
    forges a marker.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.trim(F.coalesce(F.col(speaker_col).cast("string"), F.lit("")))
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        safe(F.when(name == "", "unknown").otherwise(name)).alias("name"),
        safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"),
    ).withColumn("bucket", F.floor(F.col("turn") / part_turns))
    order = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "name", "body")
    t = t.withColumn("rn", F.row_number().over(order)).withColumn("sub", F.floor((F.col("rn") - 1) / part_turns))

    said = t.groupBy("conv_id", "bucket", "sub", "name").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("body")).alias("chars"))
    speakers = said.select("conv_id", F.col("name").alias("speaker")).distinct().filter(F.col("speaker") != SYSTEM)
    spoken = said.groupBy("conv_id", "bucket", "sub").agg(
        F.sum("k").alias("n_turns"),
        F.sum(F.col("chars") + F.col("k") * (F.length(_head(F.col("name"), F.lit(None).cast("string"))) + len(END) + 1)).alias("length"),
        F.map_from_entries(F.collect_list(F.struct("name", "k"))).alias("by_name"),
    )
    here, there = spoken.alias("p"), speakers.alias("s")
    views = here.join(there, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.*", "speaker")
    own = F.coalesce(F.try_element_at("by_name", "speaker"), F.lit(0))
    shorter = F.length(_head(F.col("speaker"), F.lit(None).cast("string"))) - F.length(_head(F.col("speaker"), F.col("speaker")))
    along = Window.partitionBy("conv_id", "speaker").orderBy(F.col("bucket").asc_nulls_first(), "sub")
    views = views.withColumn("length", F.col("length") - own * shorter).select(
        "conv_id",
        "bucket",
        "sub",
        "speaker",
        "n_turns",
        (F.row_number().over(along) - 1).alias("part"),
        F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"),
    )

    parts = t.groupBy("conv_id", "bucket", "sub").agg(F.array_sort(F.collect_list(F.struct("rn", "name", "body"))).alias("turns"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("conv_id", "bucket", "sub")]
    segments = F.transform("turns", lambda x: F.struct(_head(x["name"], F.col("speaker")).alias("head"), x["body"].alias("body"), (x["name"] == F.col("speaker")).alias("own")))
    both = views.alias("v").join(parts.alias("t"), same[0] & same[1] & same[2]).select("v.*", "turns").withColumn("segments", segments)
    lengths = F.transform("segments", lambda s: F.length(s["head"]) + F.length(s["body"]) + len(END) + 1)
    both = both.withColumn("lengths", lengths)
    begins = lambda i: F.aggregate(F.slice(F.col("lengths"), 1, i), F.lit(0), lambda a, x: a + x)
    spans = F.transform(
        "segments",
        lambda s, i: F.struct(
            (begins(i) + F.length(s["head"])).alias("start"),
            (begins(i) + F.length(s["head"]) + F.length(s["body"]) + len(END)).alias("end"),
            s["own"].alias("own"),
        ),
    )
    return both.select(
        "conv_id",
        "speaker",
        "part",
        "offset",
        "n_turns",
        F.concat_ws("", F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit(END + "\n")))).alias("rendered"),
        F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("mask"),
    )
