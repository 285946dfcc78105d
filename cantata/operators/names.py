"""File names that must not collide, with each other or with what is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.checkpoints import checkpointed
from cantata.operators.windows import running_sum


def numbered(name: Column, n: Column) -> Column:
    """'A.flac' and 2 to 'A (2).flac'; the number ends a name without an ending, or one that begins with its only dot."""
    ending = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ending))
    return F.when(n == 1, name).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ending))


def _asked_for(path: Column) -> Column:
    """The names (key, n) that, numbered, could be this path: itself at 1, and what is left without ' (n)'."""
    parts = [F.regexp_extract(path, r"(?s)^((?:.*/)?)([^/]*)$", i) for i in (1, 2)]
    bare = [F.regexp_extract(parts[1], r"(?s)^(.+) \(([1-9]\d{0,8})\)((?:\.[^.]*)?)$", i) for i in (1, 2, 3)]
    n, base = bare[1].try_cast("long"), F.concat(bare[0], bare[2])
    own = F.struct(path.alias("__key"), F.lit(1).cast("long").alias("__n"))
    less = F.when((n >= 2) & (numbered(base, n) == parts[1]), F.struct(F.concat(parts[0], base).alias("__key"), n.alias("__n")))
    return F.array_compact(F.array(own, less))


def _barred(blocks: DataFrame) -> DataFrame:
    """Blocks (__key, __n, __since) to a row for each key: its runs of numbers with one since, in order."""
    island = F.col("__n") - F.row_number().over(Window.partitionBy("__key", "__since").orderBy("__n"))
    runs = blocks.withColumn("__island", island).groupBy("__key", "__since", "__island").agg(F.min("__n").alias("first"), F.max("__n").alias("last"))
    return runs.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("first", "last", F.col("__since").alias("since")))).alias("__runs"))


def numbered_conflicts(df: DataFrame, folder: str, target: str, lead: str, occupied: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: in order of lead (a number, unique), each row takes its target or else the first number that is free.

    Free is what neither an earlier row nor occupied (one column of whole paths) has, whatever the case of letters. Rounds:
    all rows of one target take numbers at once, those barred left out; of rows that want one path the first keeps it,
    and its number is barred for the others' targets from that row on; until no two want the same. What has been given up is never
    free again for later rows, so that every round settles more; there are as many rounds as targets that push on each other.
    A target of many rows is counted by ranges (running_sum), not in one task. Barred numbers are kept as runs.
    """
    spark, at = df.sparkSession, F.col(lead).cast("long")
    path = F.lower(F.concat(F.when(F.coalesce(F.col(folder), F.lit("")) == "", "").otherwise(F.concat(F.col(folder), F.lit("/"))), F.col(target)))
    rows = checkpointed(running_sum(df.withColumn("__key", path), ["__key"], at, [at], F.lit(1).cast("long"), "__i"))
    least = -(1 << 63)
    blocks = spark.createDataFrame([], "__key string, __n long, __since long")
    if occupied is not None:
        taken = occupied.select(F.inline(_asked_for(F.lower(F.col(occupied.columns[0]))))).distinct()
        blocks = taken.join(rows.select("__key").distinct(), "__key", "left_semi").withColumn("__since", F.lit(least))
    blocks = checkpointed(blocks)
    while True:
        told = rows.select("__key", "__i", at.alias("__o"), F.col(target).alias("__target")).join(_barred(blocks), "__key", "left")
        barred = F.filter(F.coalesce("__runs", F.array().cast("array<struct<first: bigint, last: bigint, since: bigint>>")), lambda r: r["since"] < F.col("__o"))
        over = F.aggregate(barred, F.lit(0).cast("long"), lambda c, r: F.when(r["first"] <= F.col("__i") + c, c + r["last"] - r["first"] + 1).otherwise(c))
        placed = told.withColumn("__n", F.col("__i") + over)
        folder_of = F.regexp_extract("__key", r"(?s)^((?:.*/)?)", 1)
        wanted = checkpointed(placed.select("__key", "__n", "__o", F.lower(F.concat(folder_of, numbered(F.col("__target"), F.col("__n")))).alias("__path")))
        keeper = wanted.groupBy(F.col("__path").alias("__p")).agg(F.min("__o").alias("__since"), F.count(F.lit(1)).alias("__c")).filter("__c > 1")
        lost = wanted.join(keeper, F.col("__path") == F.col("__p")).filter("__o > __since").select("__key", "__n", "__since")
        # a number that an earlier row of the target has come to is its own again: the rows behind it count it already
        own = wanted.select("__key", "__n", F.col("__o").alias("__by"))
        kept = blocks.join(own, ["__key", "__n"], "left").filter("__by IS NULL OR __by > __since").drop("__by")
        changed = kept.unionByName(lost).groupBy("__key", "__n").agg(F.min("__since").alias("__since"))
        before, blocks = blocks, checkpointed(changed)
        if blocks.exceptAll(before).isEmpty() and before.exceptAll(blocks).isEmpty():
            break
    number = wanted.select(F.col("__o").alias("__at"), "__n")
    return rows.join(number, at == F.col("__at")).withColumn("name", numbered(F.col(target), F.col("__n"))).select(*df.columns, "name")
