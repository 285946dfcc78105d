"""Operators on ordered rows: firsts, streaks, sessions, runs, ranks, interleaving, peaks, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order must be total for a definite result."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def longest_streak(days: DataFrame, key: str, day: str) -> DataFrame:
    """The most consecutive days of each key: days less their rank are equal along a streak."""
    w = Window.partitionBy(key).orderBy(day)
    islands = days.select(key, day).distinct().withColumn("island", F.date_sub(F.col(day), F.row_number().over(w)))
    return islands.groupBy(key, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("streak"))


def sessions(events: DataFrame, key: str, at: str, order: list[Column], gap_seconds: int) -> DataFrame:
    """Adds ``session`` (from 1): one begins where an event is more than the gap after the latest time so far.

    The latest time so far and not the previous row's: times may step back.
    """
    w = Window.partitionBy(key).orderBy(*order)
    latest = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    begins = latest.isNull() | (micros(F.col(at)) - micros(latest) > gap_seconds * 1_000_000)
    return events.withColumn("__begins", begins.cast("long")).withColumn("session", F.sum("__begins").over(w)).drop("__begins")


def collapse_repeats(df: DataFrame, key: str, value: str, order: list[Column], weight: str) -> DataFrame:
    """Consecutive equal values become one row: key, run (from 1), value, their number and greatest weight."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.lag(value).over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    runs = df.withColumn("__c", change.cast("long")).withColumn("run", F.sum("__c").over(w))
    return runs.groupBy(key, "run", value).agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("weight"))


def range_of(df: DataFrame, lead: Column, parts: int = 256) -> Column:
    """The number of the range that a number is in, of about ``parts`` even ones; equal numbers share one."""
    splits = df.agg(F.percentile_approx(lead, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    splits = sorted({x for x in splits if x is not None})
    return F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= lead)) if splits else F.lit(0)


def running_sum(df: DataFrame, group: list[str], lead: Column, order: list, amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over the rows of the group up to this one; order begins with lead, a number.

    Each range of lead is summed in a place of its own, and told the sum of the ranges before: no task has a whole group.
    """
    placed = df.withColumn("__r", range_of(df, lead))
    sums = placed.groupBy(*group, "__r").agg(F.sum(amount).alias("__s"))
    earlier = Window.partitionBy(*group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__r").alias("__q"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*group, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__r") == F.col("__q")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    summed = placed.withColumn(name, F.sum(amount).over(within)).join(before, same)
    return summed.withColumn(name, F.col(name) + F.col("__before")).drop("__r", "__q", "__before", *[f"__g{i}" for i in range(len(group))])


def _below(counts: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """counts, one row for each value, with the sum of n over all lower values."""
    placed = counts.withColumn("__r", range_of(counts, F.col(value)))
    sums, total = {r["__r"]: r["s"] for r in placed.groupBy("__r").agg(F.sum(n).alias("s")).collect()}, 0  # a number for each of the ranges
    before = [0]
    for r in sorted(sums):
        before += [total] * (r + 1 - len(before))
        total += sums[r]
        before.append(total)
    within = F.coalesce(F.sum(n).over(Window.partitionBy("__r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, within + F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in before]), F.col("__r") + 1)).drop("__r")


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 over all rows of a numeric value, ties sharing the mean of their places.

    Distinct values are counted, and ordered a range at a time.
    """
    counts = _below(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n")), value, "__n", "__below")
    return df.join(counts.withColumn(name, F.col("__below") + (F.col("__n") + 1) / 2).drop("__n", "__below"), value)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The chance that a positive scores above a negative, ties half; null if one class is absent."""
    counts = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    counts = _below(counts, score, "n", "__below")
    won = counts.withColumn("won", F.col("p") * (2 * F.col("__below") + F.col("n"))).agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select("p", "n", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (2 * F.col("p") * F.col("n"))).alias("auc"))


def interleave(df: DataFrame, source: str, lead: Column, order: list) -> DataFrame:
    """Round robin: adds ``turn``, a row's place in its list; order by turn and source gives the sequence. order begins with lead, a number."""
    return running_sum(df, [source], lead, order, F.lit(1).cast("long"), "turn")


def recency_decay(df: DataFrame, key: str, order: list[Column], last: int, rate: float) -> DataFrame:
    """The last rows of each key with weight rate ** (places from the end)."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("back", back).filter(F.col("back") < last).withColumn("weight", F.pow(F.lit(rate), F.col("back")))


def context_pairs(df: DataFrame, key: str, value: str, order: list[Column], reach: int) -> DataFrame:
    """Skip-gram pairs (center, context) of rows at most ``reach`` places apart in a key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    around = [F.lag(value, k).over(w) for k in range(reach, 0, -1)] + [F.lead(value, k).over(w) for k in range(1, reach + 1)]
    near = df.select(F.col(value).alias("center"), F.array_compact(F.array(*around)).alias("near"))
    return near.select("center", F.explode("near").alias("context"))


def local_peaks(df: DataFrame, key: str, value: str, order: list[Column], reach: int, span: int, factor: float) -> DataFrame:
    """Rows that are the greatest within reach and at least factor times the mean within span."""
    w = Window.partitionBy(key).orderBy(*order)
    top = F.max(value).over(w.rowsBetween(-reach, reach))
    mean = F.avg(value).over(w.rowsBetween(-span, span))
    return df.withColumn("__top", top).withColumn("local_mean", mean).filter((F.col(value) == F.col("__top")) & (F.col(value) >= factor * F.col("local_mean"))).drop("__top")


def bucket_changes(df: DataFrame, key: str, bucket: Column, order: list[Column]) -> DataFrame:
    """Only rows whose bucket differs from the previous row's of the key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("bucket", bucket).withColumn("__b", F.lag("bucket").over(w)).filter(F.col("__b").isNull() | (F.col("__b") != F.col("bucket"))).drop("__b")


def strata(df: DataFrame, group: str, lead: Column, order: list, parts: int, name: str = "stratum") -> DataFrame:
    """Adds a number from 1 to parts: each group in that many runs of order, whose sizes differ by one at most, larger ones first."""
    counts = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sum(df, [group], lead, order, F.lit(1).cast("long"), "__p").join(counts, F.col(group).eqNullSafe(F.col("__g")))
    size, longer = F.floor(F.col("__n") / parts), F.col("__n") % parts
    at, head = F.col("__p") - 1, longer * (size + 1)
    return placed.withColumn(name, (F.when(at < head, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - head) / size)) + 1).cast("int")).drop("__g", "__n", "__p")


def evict_to_budget(df: DataFrame, group: str, size: str, lead: Column, order: list, budget: int) -> DataFrame:
    """Oldest rows first until what is left fits the budget; returns the evicted ones, by group. order begins with lead, a number."""
    totals = df.groupBy(F.col(group).alias("__g")).agg(F.sum(size).alias("__t"))
    summed = running_sum(df, [group], lead, order, F.coalesce(F.col(size), F.lit(0)), "__s").join(totals, F.col(group).eqNullSafe(F.col("__g")))
    return summed.filter(F.col("__t") - F.col("__s") + F.coalesce(F.col(size), F.lit(0)) > budget).drop("__g", "__t", "__s")


def fractional_cap(df: DataFrame, group: str, member: str, order: list[Column], share: float) -> DataFrame:
    """At most a share (rounded up) of each group's rows for one member, the first ones."""
    totals = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__t"))
    place = F.row_number().over(Window.partitionBy(group, member).orderBy(*order))
    placed = df.withColumn("__p", place).join(totals, F.col(group).eqNullSafe(F.col("__g")))
    return placed.filter(F.col("__p") <= F.ceil(F.col("__t") * share)).drop("__g", "__t", "__p")
