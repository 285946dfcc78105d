"""Listening statistics over daily facts: totals, comparisons of periods, firsts, monthly leaders, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(events: DataFrame, at: str, keys: list[str], amount: Column) -> DataFrame:
    return events.groupBy(F.to_date(at).alias("day"), *keys).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("plays"))


def exploded_credits(facts: DataFrame, credits: Column, amount: str) -> DataFrame:
    """credit, amount in full for each credit, and its even share."""
    rows = facts.withColumn("__c", credits).select(F.explode("__c").alias("credit"), F.col(amount).alias("amount"), (F.col(amount) / F.size("__c")).alias("share"))
    return rows.groupBy("credit").agg(F.sum("amount").alias("amount"), F.sum("share").alias("share"))


def compare_periods(facts: DataFrame, day: str, amount: str, end, days: int, keys: list[str]) -> DataFrame:
    """Each key's total in the days up to end (exclusive) and in as many before, and the change in per cent."""
    d = F.col(day)
    start, before = F.date_sub(F.lit(end), days), F.date_sub(F.lit(end), 2 * days)
    now, then = F.sum(F.when(d >= start, F.col(amount)).otherwise(0)), F.sum(F.when(d < start, F.col(amount)).otherwise(0))
    return facts.filter((d >= before) & (d < F.lit(end))).groupBy(*keys).agg(now.alias("current"), then.alias("previous")).withColumn(
        "change", F.when(F.col("previous") != 0, (F.col("current") - F.col("previous")) * 100 / F.col("previous"))
    )


def new_entities(facts: DataFrame, key: str, day: str, start, end) -> DataFrame:
    """Keys first seen within [start, end); none if nothing is older than start."""
    first = facts.groupBy(key).agg(F.min(day).alias("first_day"))
    older = first.filter(F.col("first_day") < F.lit(start)).limit(1).select(F.lit(1).alias("__any"))
    return first.filter((F.col("first_day") >= F.lit(start)) & (F.col("first_day") < F.lit(end))).join(F.broadcast(older)).drop("__any")


def leader_per_month(facts: DataFrame, day: str, key: str, amount: str) -> DataFrame:
    totals = facts.groupBy(F.date_trunc("month", day).cast("date").alias("month"), key).agg(F.sum(amount).alias("amount"))
    w = Window.partitionBy("month").orderBy(F.desc("amount"), key)
    return totals.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def most_loyal(facts: DataFrame, key: str, day: str, amount: str, n: int = 1) -> DataFrame:
    """The keys with the most distinct days; the larger amount, then the key itself, decides between equals."""
    return facts.groupBy(key).agg(F.count_distinct(day).alias("days"), F.sum(amount).alias("amount")).orderBy(F.desc("days"), F.desc("amount"), key).limit(n)


def upsert_totals(stored: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], latest: list[str]) -> DataFrame:
    """Adds a batch of deltas: sums add up, of the other columns the delta's value counts unless it is null."""
    both = stored.withColumn("__o", F.lit(0)).unionByName(delta.withColumn("__o", F.lit(1)))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__o"))).alias(c) for c in latest])


def split_at_midnight(spans: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    """Spans (timestamps) to a row for each day that they touch: day, seconds within it."""
    days = F.sequence(F.to_date(start), F.to_date(end))
    rows = spans.filter(F.col(end) > F.col(start)).select(*keep, start, end, F.explode(days).alias("day"))
    begin, finish = F.greatest(F.col(start), F.col("day").cast("timestamp")), F.least(F.col(end), F.date_add("day", 1).cast("timestamp"))
    return rows.withColumn("seconds", F.unix_timestamp(finish) - F.unix_timestamp(begin)).filter("seconds > 0").select(*keep, "day", "seconds")


def power_mean_level(df: DataFrame, keys: list[str], level: Column, weight: Column) -> DataFrame:
    """Weighted power mean of levels in decibels."""
    return df.groupBy(*keys).agg((10 * F.log10(F.sum(F.pow(F.lit(10.0), level / 10) * weight) / F.sum(weight))).alias("level"))
