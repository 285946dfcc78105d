"""Aggregates over albums, artists and lists: summaries, previews, majorities, shared credits, last metrics, gaps, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions.text import lookup_text, trimmed


def search_groups(rows: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """The groups that a search finds rows of, with the number of those."""
    return rows.filter(found).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def lookup_summary(rows: DataFrame, source: str, kinds: list[str]) -> DataFrame:
    """source, kind, value and how often it is used; blanks aren't kept. One pass and one shuffle for all kinds."""
    each = rows.select(source, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])).alias("v"))
    return each.select(source, "v.*").filter("value IS NOT NULL AND trim(value) <> ''").groupBy(source, "kind", "value").agg(F.count(F.lit(1)).alias("uses"))


def active_values(summary: DataFrame, source: str, active: DataFrame) -> DataFrame:
    """The values in use by an active source, each once."""
    return summary.filter("uses > 0").join(active.select(source), source, "left_semi").select("kind", "value").distinct()


def counts_having(parents: DataFrame, key: str, children: DataFrame, foreign: str, keep: Column) -> DataFrame:
    """Parents with their number of children ``n``, those without included, if they have any or meet a condition."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return parents.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter((F.col("n") > 0) | keep)


def totals_by_name(rows: DataFrame, names: list[str], amount: str, tie: str) -> DataFrame:
    """Sums by names whatever their case; the spelling of the greatest amount (then the lowest tie) is shown. The first name isn't blank."""
    lead = F.struct(F.col(amount), -F.col(tie))
    shown = [F.max_by(trimmed(F.col(n)), lead).alias(n) for n in names]
    keyed = rows.filter(lookup_text(F.col(names[0])) != "")
    grouped = keyed.groupBy(*[lookup_text(F.col(n)).alias(f"__k{i}") for i, n in enumerate(names)])
    return grouped.agg(*shown, F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n")).drop(*[f"__k{i}" for i in range(len(names))])


def list_summary(lists: DataFrame, key: str, members: DataFrame, foreign: str, order: list[str], preview: str) -> DataFrame:
    """Each list with its number of members and the first one's preview (null if it is empty)."""
    summary = members.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias("n"), F.min_by(preview, F.struct(*order)).alias("preview"))
    return lists.join(summary, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_folder(files: DataFrame, source: str, path: str) -> DataFrame:
    """source, folder, the number of files right in it and the name of the first and the last."""
    folder, name = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return files.groupBy(source, folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


def leading_tag(tags: DataFrame, item: str, name: str, votes: str, place: str) -> DataFrame:
    """Each item's tag of most votes, the first of equals. Of names equal but for case only the first counts."""
    first = tags.filter(lookup_text(F.col(name)) != "").groupBy(item, lookup_text(F.col(name)).alias("__name"))
    once = first.agg(F.min_by(F.struct(trimmed(F.col(name)).alias("tag"), votes, place), place).alias("t")).select(item, "t.*")
    return once.groupBy(item).agg(F.max_by("tag", F.struct(F.col(votes), -F.col(place))).alias("tag"))


def majority(rows: DataFrame, group: str, category: str) -> DataFrame:
    """group and its most frequent category, ties by name; groups without any are left out."""
    counts = rows.filter(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(category, F.struct(-F.col("n"), F.col(category))).alias("majority"))


def fill_by_majority(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Rows without a category take their group's most frequent one."""
    top = majority(rows, group, category).withColumnRenamed(group, "__g")
    return rows.join(top, F.col(group) == F.col("__g"), "left").withColumn(category, F.coalesce(category, "majority")).drop("__g", "majority")


def shared_credits(tracks: DataFrame, album: str, track: str, credits: Column) -> DataFrame:
    """album and every credit that all of its tracks have (two tracks or more), whatever the case."""
    each = tracks.select(album, track, F.explode(F.array_distinct(F.transform(credits, lookup_text))).alias("credit"))
    sizes = tracks.groupBy(album).agg(F.count_distinct(track).alias("tracks")).filter("tracks > 1")
    named = each.distinct().groupBy(album, "credit").agg(F.count(F.lit(1)).alias("n"))
    return named.join(sizes, album).filter("n = tracks").select(album, "credit")


def recent_groups(rows: DataFrame, key: Column, member: str, at: str) -> DataFrame:
    """Each group's latest member, its time and number; a group of one goes by the member, others by the key: kind, id, at, n."""
    grouped = rows.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.max_by(member, F.struct(at, member)).alias("__last"), F.max(at).alias("last_at"))
    single = F.col("n") == 1
    return grouped.select(F.when(single, "single").otherwise("album").alias("kind"), F.when(single, F.col("__last").cast("string")).otherwise(F.col("__key")).alias("id"), "last_at", "n")


def album_groups(rows: DataFrame, album: str, added: str, cover: str, order: list[str]) -> DataFrame:
    """Albums of more than one track: tracks, when the newest came, and the first cover that isn't blank."""
    place = F.when(trimmed(F.col(cover)) != "", F.struct(*order))
    return rows.groupBy(album).agg(F.count(F.lit(1)).alias("tracks"), F.max(added).alias("newest"), F.min_by(cover, place).alias("cover")).filter("tracks > 1")


def last_metric(log: Column, name: str) -> Column:
    """The last number that a log gives after 'name:'; null if there is none."""
    import re

    return F.try_element_at(F.regexp_extract_all(log, F.lit(rf"\b{re.escape(name)}:\s*(-?\d+(?:\.\d+)?)"), 1), F.lit(-1)).cast("double")


def with_gaps(lines: DataFrame, key: str, at: str, end: str, text: str, order: list[str], least: int) -> DataFrame:
    """Lines that have a text, and an empty row (at, end) for every wait of at least ``least`` before one.

    A wait begins at the previous line's end, or where that isn't known at the first blank line after it (before the
    first line: at 0), but not before all earlier lines have ended. Ends before their lines don't count.
    """
    w = Window.partitionBy(key).orderBy(*order)
    sung = lookup_text(F.col(text)) != ""
    numbered = lines.withColumn("__sung", sung).withColumn("__g", F.sum(F.col("__sung").cast("long")).over(w) - F.col("__sung").cast("long"))
    blank = F.min(F.when(~F.col("__sung"), F.col(at))).over(Window.partitionBy(key, "__g"))
    vocal = numbered.withColumn("__blank", blank).filter("__sung").withColumn("__end", F.when(F.col(end) >= F.col(at), F.col(end)))
    start = F.when(F.col("__g") == 0, 0).otherwise(F.coalesce(F.lag("__end").over(w), F.col("__blank")))
    ended = F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = vocal.withColumn("__start", start).withColumn("__start", F.when(F.col("__start").isNotNull(), F.greatest("__start", ended)))
    gaps = told.filter(F.col(at) - F.col("__start") >= least).select(key, F.col("__start").alias(at), F.col(at).alias(end), F.lit("").alias(text))
    return told.select(key, at, end, text).unionByName(gaps)


def last_occurrence(rows: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """For each value of a key how many rows came after its last one; order is the latest first."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("back", back).groupBy(key, value).agg(F.min("back").alias("back"), F.count(F.lit(1)).alias("n"))


def local_strength(rows: DataFrame, key: str, value: str, order: list[str], near: int = 8, far: int = 43, most: float = 6.0) -> DataFrame:
    """Adds ``strength``: what a value has over its near mean, against the root mean square of that farther around.

    The square is at least a hundredth of the key's mean one, and the strength ``most`` at most.
    """
    w = Window.partitionBy(key).orderBy(*order)
    above = rows.withColumn("__x", F.greatest(F.col(value) - F.avg(value).over(w.rowsBetween(-near, near)), F.lit(0.0)))
    square = F.col("__x") * F.col("__x")
    local = F.avg(square).over(w.rowsBetween(-far, far))
    floor = F.avg(square).over(Window.partitionBy(key)) * 0.01
    root = F.sqrt(F.greatest(local, floor))
    return above.withColumn("strength", F.when(root > 0, F.least(F.col("__x") / root, F.lit(most))).otherwise(0.0)).drop("__x")


def best_lag(rows: DataFrame, key: str, value: str, order: list[str], lags: list[float], prior: dict[float, float] | None = None) -> DataFrame:
    """key, lag, score: the lag at which a key's values are most like themselves, by normalised product times its prior.

    A lag between two places takes both in proportion. All lags of the grid are summed in one pass; ties go to the first.
    """
    w = Window.partitionBy(key).orderBy(*order)
    x = F.col(value)

    def delayed(lag: float) -> Column:
        whole, part = int(lag), lag - int(lag)
        return F.lag(value, whole).over(w) if not part else F.lag(value, whole + 1).over(w) * part + F.lag(value, whole).over(w) * (1 - part)

    late = rows.select(key, x, *[delayed(lag).alias(f"__d{i}") for i, lag in enumerate(lags)])
    sums = []
    for i in range(len(lags)):
        d = F.col(f"__d{i}")
        sums += [F.sum(x * d).alias(f"__p{i}"), F.sum(F.when(d.isNotNull(), x * x)).alias(f"__l{i}"), F.sum(d * d).alias(f"__r{i}")]
    score = lambda i, lag: F.col(f"__p{i}") / F.sqrt(F.greatest(F.col(f"__l{i}").cast("double") * F.col(f"__r{i}"), F.lit(1e-9))) * (prior or {}).get(lag, 1.0)
    each = F.array(*[F.struct(score(i, lag).alias("score"), F.lit(-i).alias("at"), F.lit(float(lag)).alias("lag")) for i, lag in enumerate(lags)])
    best = late.groupBy(key).agg(*sums).withColumn("__b", F.array_max(F.filter(each, lambda s: s["score"].isNotNull())))
    return best.select(key, F.col("__b.lag").alias("lag"), F.col("__b.score").alias("score"))
