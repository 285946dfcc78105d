"""A revisioned feed of changes: what is there, what was removed, and an answer for every cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compacted(feed: DataFrame, key: str, seq: str, removed: Column, horizon: int) -> DataFrame:
    """The feed with the last row of each key and ``removed``: what a cursor from the horizon on may still need.

    Removals before the horizon go, since a cursor older than it is told everything anew. Compacting twice, or what has
    been compacted with what came since, gives the same. Aggregated before it is shuffled.
    """
    rest = [c for c in feed.columns if c not in (key, seq, "removed")]
    row = F.struct(removed.cast("boolean").alias("removed"), *rest)
    last = feed.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(row, seq).alias("__row")).select(key, seq, "__row.*")
    return last.filter(~F.coalesce("removed", F.lit(False)) | (F.col(seq) >= horizon)).withColumn("removed", F.coalesce("removed", F.lit(False)))


def delta(table: DataFrame, seq: str, since: int, horizon: int) -> DataFrame:
    """What a cursor is told of a compacted table: its rows after the cursor, items and removals, with ``reset``.

    A cursor of nothing, or from before the horizon, is told to begin anew: all items, reset, and no removals. One that is at
    the end is told nothing.
    """
    reset = since <= 0 or since < horizon
    rows = table.filter("NOT removed") if reset else table.filter(F.col(seq) > since)
    last = table.agg(F.max(seq).alias("__last"))  # one row
    return rows.join(F.broadcast(last)).filter(F.col("__last") > since).withColumn("reset", F.lit(reset)).drop("__last")


def followed(known: DataFrame, told: DataFrame, key: str, reset: bool) -> DataFrame:
    """A follower's items after an answer: what it knew, with the answer's items put in and its removals taken out."""
    items = told.filter("NOT removed").select(*known.columns)
    return items if reset else known.join(told.select(key), key, "left_anti").unionByName(items)
