"""Orders and what is picked by them: sort modes, pages, branches, partial dates, shuffles, ranges, unions by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions.text import fnv1a, lookup_text
from cantata.operators.windows import running_sum

# The sort modes by name, each the field that leads and whether it falls.
SORT_MODES = {
    "latest": ("added", True), "oldest": ("added", False), "a-z": ("name", False), "z-a": ("name", True),
    "artist-asc": ("artist", False), "artist-desc": ("artist", True), "album-asc": ("album", False), "album-desc": ("album", True),
    "release-oldest": ("release", False), "release-newest": ("release", True), "genre-asc": ("genre", False), "genre-desc": ("genre", True),
    "size-asc": ("size", False), "size-desc": ("size", True),
}


def sort_terms(mode: str, fields: dict[str, str]) -> list[Column]:
    """The order of a mode ('latest' for an unknown one); fields names a column for each field, with name, source and key.

    Unknown sizes come last both ways. Source and key end every order, so that it is total.
    """
    field, falls = SORT_MODES.get(mode, SORT_MODES["latest"])
    way = lambda c, down: F.col(fields[c]).desc_nulls_last() if down else F.col(fields[c]).asc_nulls_first()
    unknown_last = [F.col(fields["size"]).isNull().asc()] if field == "size" else []
    after = way("artist", falls) if field == "name" else way("name", False)
    return [*unknown_last, way(field, falls), after, way("source", False), way("key", False)]


def page(df: DataFrame, order: list[Column], size: int, skip: int = 0) -> DataFrame:
    """A page of rows with their ``position`` in the whole order, from 1; the page alone is numbered in one place."""
    rows = df.orderBy(*order).offset(skip).limit(size)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + skip)


def branch_page(branches: list[DataFrame], order: list[Column], size: int) -> DataFrame:
    """The first rows of a union, of which each branch hands on its own first rows only."""
    return reduce(DataFrame.unionByName, [b.orderBy(*order).limit(size) for b in branches]).orderBy(*order).limit(size)


def album_order(disc: Column, track: Column, name: Column) -> list[Column]:
    """Disc 1 and track 999 where there is none, then the name."""
    return [F.coalesce(disc, F.lit(1)).asc(), F.coalesce(track, F.lit(999)).asc(), lookup_text(name).asc()]


def folder_order(df: DataFrame, folder: str, album: str, disc: str, track: str, name: str) -> DataFrame:
    """Adds by_disc, by_track, by_name, the order within a folder: numbers count if it holds one album, all numbered."""
    title = lookup_text(F.col(album))
    kinds = df.groupBy(F.col(folder).alias("__f")).agg(((F.min(title) == F.max(title)) & (F.count(track) == F.count(F.lit(1)))).alias("__numbered"))
    told = df.join(kinds, F.col(folder).eqNullSafe(F.col("__f")))
    number = lambda c: F.when(F.col("__numbered"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    return told.select(*df.columns, number(disc).alias("by_disc"), number(track).alias("by_track"), F.lower(F.col(name)).alias("by_name"))


def rewrite_stamps(df: DataFrame, group: list[str], lead: Column, order: list, start: int) -> DataFrame:
    """Adds ``stamp``: after a reordering each row of a list is stamped with its new place."""
    return running_sum(df, group, lead, order, F.lit(1).cast("long"), "stamp").withColumn("stamp", F.col("stamp") - 1 + start)


def shuffle_key(day: str, item: Column) -> Column:
    """Sorts the items by chance, alike all day and everywhere."""
    return fnv1a(F.concat(F.lit(f"{day}|"), item.cast("string")))


def priority_key(c: Column, first: list[str]) -> Column:
    """The place in a list of names, and one beyond it for the others; order by it and then by name."""
    at = F.array_position(F.array(*map(F.lit, first)), c)
    return F.when(at > 0, at).otherwise(len(first) + 1).cast("int")


def newest_ids(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """Rows of the n highest ids there could be: a log's retention."""
    last = df.agg(F.max(row_id).alias("__last"))  # one row
    return df.join(F.broadcast(last)).filter(F.col(row_id) > F.col("__last") - n).drop("__last")


def partial_date_key(c: Column) -> Column:
    """yyyymmdd of a date that may lack day or month (then 1); 0 for anything that is no date."""
    text = F.trim(F.coalesce(c, F.lit("")))
    shape = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T.*)?)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit("01"))
    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    stamped = (F.length(text) <= 10) | F.try_to_timestamp(text).isNotNull()
    return F.when(text.rlike(shape) & (part(1) != "0000") & day.isNotNull() & stamped, F.date_format(day, "yyyyMMdd").cast("int")).otherwise(0)


def merged_recents(parts: list[DataFrame], keys: list[str], at: str, size: int) -> DataFrame:
    """The latest entries of several lists, each thing once, at its latest time; ties by key."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max(at).alias(at)).orderBy(F.desc(at), *keys).limit(size)


def between_items(df: DataFrame, item: str, order: list[str], one: object, other: object) -> DataFrame:
    """Rows from one item to another, both included, whichever comes first; none unless both are there."""
    ends = df.filter(F.col(item).isin(one, other)).select(F.struct(*order).alias("s"))
    ends = ends.agg(F.min("s").alias("__lo"), F.max("s").alias("__hi"), F.count(F.lit(1)).alias("__n"))  # one row
    place = F.struct(*order)
    found = df.join(F.broadcast(ends.filter(F.col("__n") == len({one, other}))))
    return found.filter((place >= F.col("__lo")) & (place <= F.col("__hi"))).drop("__lo", "__hi", "__n")


def first_with_rows(strategies: list[DataFrame]) -> DataFrame:
    """What the first strategy that finds anything finds, with its number."""
    each = reduce(DataFrame.unionByName, [s.withColumn("strategy", F.lit(i)) for i, s in enumerate(strategies)])
    first = each.agg(F.min("strategy").alias("__s"))  # one row
    return each.join(F.broadcast(first), F.col("strategy") == F.col("__s")).drop("__s")


def first_wins(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """A union in which the first part that has a key gives its row (of several the first in order), and ``part``.

    Aggregated before it is shuffled, so that no task has all the rows of a key.
    """
    each = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    others = [c for c in each.columns if c not in keys]
    best = each.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("part", order)).alias("__row"))
    return best.select(*keys, "__row.*")


def distinct_first(df: DataFrame, member: str, lead: str, order: list[str], n: int, turn: int = 0) -> DataFrame:
    """Up to n rows to start from, no member twice while others remain; each turn starts n rows farther, and goes round.

    lead, a number, begins the order. Adds ``pick`` from 1. Only the first n rows of either kind are ordered together.
    """
    placed = running_sum(df, [], F.col(lead), order, F.lit(1).cast("long"), "__at")
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    turned = placed.join(F.broadcast(total)).withColumn("__at", F.pmod(F.col("__at") - 1 - turn * n, F.col("__total"))).drop("__total")
    firsts = turned.groupBy(F.col(member).alias("__m")).agg(F.min("__at").alias("__first"))
    each = turned.join(firsts, F.col(member).eqNullSafe(F.col("__m"))).withColumn("__again", F.col("__at") != F.col("__first"))
    head = each.orderBy("__again", "__at").limit(n)
    return head.withColumn("pick", F.row_number().over(Window.orderBy("__again", "__at"))).drop("__m", "__first", "__again", "__at")
