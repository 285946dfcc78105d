"""Joins that Spark has no single operator for: anti-joins on several keys, priorities, as-of, intervals, division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_shadowed(rows: DataFrame, shadows: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows that no shadow has: one anti-join for each (column of rows, shadow, its column), nulls never match."""
    return reduce(lambda left, s: left.join(s[1].select(F.col(s[2]).alias(s[0])), s[0], "left_anti"), shadows, rows)


def existence_flag(rows: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """Adds a flag: does other have the key? Rows stay as many as they were."""
    keys = other.select(F.col(other_key).alias(key), F.lit(True).alias(name)).distinct()
    return rows.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def priority_lookup(requests: DataFrame, request_id: str, kinds: list[tuple[Column, DataFrame]], order: list[Column]) -> DataFrame:
    """For each request the best candidate over several kinds of key, earlier kinds first.

    kinds: (key of the request, candidates with ``key``, ``candidate`` and what order needs). Order is of the candidates
    alone, so only the first of each (kind, key) is joined; requests without a candidate are left out.
    """
    asked = requests.select(
        request_id,
        F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), k.cast("string").alias("key")) for i, (k, _) in enumerate(kinds)])).alias("ask"),
    ).select(request_id, "ask.*").filter("key IS NOT NULL AND key <> ''")
    found = reduce(DataFrame.unionByName, [c.withColumn("kind", F.lit(i)).withColumn("key", F.col("key").cast("string")) for i, (_, c) in enumerate(kinds)])
    first = F.row_number().over(Window.partitionBy("kind", "key").orderBy(*order))
    found = found.withColumn("__rn", first).filter("__rn = 1").drop("__rn")
    rn = F.row_number().over(Window.partitionBy(request_id).orderBy("kind"))
    return asked.join(found, ["kind", "key"]).withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time (null if none).

    One union and one ordered window: no pair of rows is ever made. Of right rows at one time the greatest
    values (as a struct) count.
    """
    packed = F.struct(*values)
    a = left.withColumn("__v", F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType)).withColumn("__left", F.lit(True))
    b = right.select(by, at, packed.alias("__v"), F.lit(False).alias("__left"))
    w = Window.partitionBy(by).orderBy(F.col(at), F.col("__left"), F.col("__v")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__left")
    return both.select(*left.columns, *[F.col("__v")[v].alias(v) for v in values])


def stabbing(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every interval of their key that start <= at < end holds for (numbers).

    Intervals are dealt into all buckets of the width that they touch, so the join is an equi-join; an interval
    longer than the width costs a row for each bucket.
    """
    last = F.greatest(F.col(start), F.col(end) - 1)
    spread = intervals.filter(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    return points.withColumn("__b", F.floor(F.col(at) / width)).join(spread, [by, "__b"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__b")


def nearest_within(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, left_id: str, right_id: str, tolerance: int) -> DataFrame:
    """Each right row with its nearest left row within the tolerance; a contested left row goes to the closest."""
    home = F.floor(F.col(right_at) / (tolerance + 1))
    b = right.withColumn("__b", F.explode(F.array(home - 1, home, home + 1)))
    near = left.withColumn("__b", F.floor(F.col(left_at) / (tolerance + 1))).join(b, [by, "__b"])
    near = near.withColumn("distance", F.abs(F.col(left_at) - F.col(right_at))).filter(F.col("distance") <= tolerance)
    mine = F.row_number().over(Window.partitionBy(by, right_id).orderBy("distance", left_at, left_id))
    theirs = F.row_number().over(Window.partitionBy(by, left_id).orderBy("distance", right_at, right_id))
    return near.withColumn("__m", mine).filter("__m = 1").withColumn("__t", theirs).filter("__t = 1").drop("__m", "__t", "__b")


def has_all(groups: DataFrame, key: str, needed: DataFrame, present: DataFrame, parts: int | None = None) -> DataFrame:
    """Relational division: keys all of whose needed (key, item) rows are among the present, in so many parts by key, if told.

    Both are one table of marks, so that they move once, by key; a null is among nothing.
    """
    item = [c for c in needed.columns if c != key]
    whole = reduce(lambda x, c: x & F.col(c).isNotNull(), item, F.lit(True))
    marked = needed.select(key, *item, F.lit(True).alias("__needed"), F.lit(False).alias("__found")).unionByName(present.select(key, *item, F.lit(False).alias("__needed"), whole.alias("__found")))
    marked = marked.repartition(parts, key) if parts else marked
    each = marked.groupBy(key, *item).agg(F.bool_or("__needed").alias("__needed"), F.bool_or("__found").alias("__found")).filter("__needed")
    return groups.join(each.groupBy(key).agg(F.bool_and("__found").alias("__all")).filter("__all").select(key), key, "left_semi")


def longest_tail(paths: DataFrame, path_id: str, path: str, targets: DataFrame, target_id: str, target: str, longest: int = 3) -> DataFrame:
    """Each path with the one target that shares its longest tail (of 1 to `longest` segments).

    A tail that several targets have decides nothing, not even that a shorter one may: such paths find nothing.
    """

    def tails(df: DataFrame, name: str, value: str) -> DataFrame:
        parts = F.filter(F.split(F.lower(F.col(value)), r"[/\\]+"), lambda p: p != "")
        each = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(parts))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, -k, k), "/").alias("tail")))
        return df.filter(F.size(parts) > 0).select(name, F.explode(each).alias("t")).select(name, "t.*")

    known = tails(targets, target_id, target).groupBy("k", "tail").agg(F.count_distinct(target_id).alias("n"), F.min(target_id).alias(target_id))
    best = tails(paths, path_id, path).join(known, ["k", "tail"])
    rn = F.row_number().over(Window.partitionBy(path_id).orderBy(F.desc("k")))
    return best.withColumn("__rn", rn).filter("__rn = 1 AND n = 1").select(path_id, target_id, "k")


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, as an array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def longest_prefix(rows: DataFrame, row_id: str, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Each row with the longest root that is its path or a folder above it; found by equality with its ancestors."""
    each = rows.withColumn("__up", F.explode(ancestors(F.col(path))))
    known = roots.withColumn("__up", F.regexp_replace(root, "/+$", ""))
    rn = F.row_number().over(Window.partitionBy(row_id).orderBy(F.length("__up").desc(), root))
    return each.join(known, "__up").withColumn("__rn", rn).filter("__rn = 1").drop("__rn", "__up")


def scored_match(pairs: DataFrame, request: str, candidate: str, score: Column, least: int, margin: int) -> DataFrame:
    """The best candidate of each request if it reaches the least score and leads the runner-up by the margin."""
    w = Window.partitionBy(request).orderBy(F.desc("score"), candidate)
    ranked = pairs.withColumn("score", score).withColumn("__rn", F.row_number().over(w)).withColumn("__next", F.lead("score").over(w))
    clear = F.col("__next").isNull() | (F.col("score") - F.col("__next") >= margin)
    return ranked.filter((F.col("__rn") == 1) & (F.col("score") >= least) & clear).select(request, candidate, "score")
