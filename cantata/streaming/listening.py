"""Listening as streams: daily totals that late data may still change, sessions, plays counted once, upserted sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cantata.operators.listening import upsert_totals

WATERMARK = "2 hours"


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, at: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Events later than the delay behind the latest one are dropped by the stateful operators downstream."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def daily_totals(events: DataFrame, key: str, amount: str, at: str = "ts") -> DataFrame:
    return events.groupBy(F.window(at, "1 day"), key).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("plays")).select(F.to_date("window.start").alias("day"), key, "amount", "plays")


def session_totals(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of ordered events: a gap of exactly the given time still continues one."""
    return events.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def counted_plays(ticks: DataFrame, key: str = "user_id", track: str = "track", at: str = "ts", after_seconds: float = 30.0) -> DataFrame:
    """A play of a track counts once, when its ticks have run for the given time; another track starts anew.

    State is one small row for each key: the track, its start and whether it has been counted; it expires after two
    hours without a tick. Ticks of one batch are taken in order of time.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, start, counted = state.get if state.exists else (None, 0.0, False)
        found = []
        ticks_ = pd.concat(list(batches)).sort_values([at, track], kind="stable")
        for name, seconds in zip(ticks_[track], ticks_[at].astype("datetime64[us]").astype("int64") / 1e6, strict=True):
            if name != current:
                current, start, counted = name, float(seconds), False
            elif not counted and seconds - start >= after_seconds:
                counted = True
                found.append((group[0], name, pd.Timestamp(seconds, unit="s")))
        state.update((current, start, counted))
        state.setTimeoutDuration(2 * 3600 * 1000)
        if found:
            yield pd.DataFrame(found, columns=[key, track, "counted_at"])

    kinds = {f.name: f.dataType.simpleString() for f in ticks.schema}
    return ticks.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{track}` {kinds[track]}, counted_at timestamp", f"`{track}` {kinds[track]}, start double, counted boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def merge_into(path: str, keys: list[str], sums: list[str], latest: list[str] | tuple = (), at: str | None = None):
    """For foreachBatch: adds each batch of deltas to the totals stored under path.

    Of a batch's values of the columns ``latest`` the one of the greatest time ``at`` counts (of equal times, or without
    one, the greatest value).

    Each version is a folder named by its batch, written whole and then read back as the next one's start; a batch
    that is tried again writes the same version from the same start, so nothing is added twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(at) if at else F.lit(0), F.col(c)))).alias(c) for c in latest])
        if batch_id:
            delta = upsert_totals(batch.sparkSession.read.parquet(f"{path}/v={batch_id - 1}"), delta, keys, sums, list(latest))
        delta.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def totals(spark: SparkSession, path: str, last_batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={last_batch}")
