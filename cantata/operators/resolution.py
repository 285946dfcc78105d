"""Which known thing is meant: cascades of keys, aliases, scored candidates, caches and plans of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions.scores import artist_variants, path_aliases, title_variants
from cantata.functions.text import trimmed


def known_by(known: DataFrame, key: Column, target: str) -> DataFrame:
    """key and its lowest target; blank keys find nothing. One row a key, so that joining it makes no further rows."""
    keyed = known.select(key.cast("string").alias("__key"), target).filter("__key IS NOT NULL AND trim(__key) <> ''")
    return keyed.groupBy("__key").agg(F.min(target).alias("__target"))


def cascade(rows: DataFrame, stages: list[tuple[str, Column, DataFrame, Column, str]], name: str) -> DataFrame:
    """rows with the target (``name``) that the first stage to find one finds, and ``found_by`` ('' where none does).

    stages: (label, key of a row, known things, their key, their target). Each is an equi-join with one row a key.
    """
    out, kept = rows, rows.columns
    for i, (_, key, known, known_key, target) in enumerate(stages):
        found = known_by(known, known_key, target).toDF(f"__k{i}", f"__t{i}")
        out = out.withColumn(f"__key{i}", key.cast("string")).join(found, F.col(f"__key{i}") == F.col(f"__k{i}"), "left")
    each = [F.col(f"__t{i}") for i in range(len(stages))]
    by = reduce(lambda w, i: w.when(each[i].isNotNull(), stages[i][0]), range(1, len(stages)), F.when(each[0].isNotNull(), stages[0][0]))
    return out.select(*kept, F.coalesce(*each).alias(name), by.otherwise("").alias("found_by"))


def physical_matches(rows: DataFrame, row_id: str, path: str, wanted: DataFrame, wanted_path: str) -> DataFrame:
    """Ids of rows that are the same file as a wanted path, however either is written."""
    keys = wanted.select(F.explode(path_aliases(F.col(wanted_path))).alias("__key")).distinct()
    return rows.select(row_id, F.explode(path_aliases(F.col(path))).alias("__key")).join(keys, "__key", "left_semi").select(row_id).distinct()


def best_scored(pairs: DataFrame, request: list[str], candidate: str, score: Column, least: int) -> DataFrame:
    """Each request's best candidate of at least the score (ties: the lowest), aggregated before it is shuffled."""
    order = F.struct(score.alias("score"), (-F.col(candidate)).alias("__last"))  # scored once: filtered after, not before
    best = pairs.groupBy(*request).agg(F.max(order).alias("__best")).filter(F.col("__best.score") >= least)
    return best.select(*request, (-F.col("__best.__last")).alias(candidate), F.col("__best.score").alias("score"))


def surest(pairs: DataFrame, request: list[str], candidate: str, score: Column, exact: Column, least: int = 85, clear: int = 10, gap: int = 8) -> DataFrame:
    """Each request's best candidate, unless it is below the least score, or below that and ``clear`` with another within ``gap``.

    An exact one is taken whatever its score. The pairs are scored once; each task hands on the best two of a request.
    """
    ranked = pairs.withColumn("score", score).withColumn("__exact", F.coalesce(exact, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*request).orderBy(F.desc("score"), candidate))
    two = ranked.select(*request, candidate, "score", "__exact").withColumn("__place", place).filter("__place <= 2")
    first = F.col("__place") == 1
    best = two.groupBy(*request).agg(F.max(F.when(first, F.struct(candidate, "score", "__exact"))).alias("__best"), F.max(F.when(~first, F.col("score"))).alias("__next"))
    told = best.select(*request, "__best.*", "__next")
    unsure = (F.col("score") < least + clear) & F.coalesce(F.col("score") - F.col("__next") <= gap, F.lit(False))
    return told.filter(F.col("__exact") | ((F.col("score") >= least) & ~unsure)).select(*request, candidate, "score")


def recognised(asked: DataFrame, request: str, title: str, artist: str, known: DataFrame, known_title: str, known_artist: str, target: str) -> DataFrame:
    """Each request's known song by the first pair of title and artist forms that is known: request, target, attempt.

    Attempts go through the artist's forms within each of the title's.
    """
    forms = asked.select(request, F.posexplode(title_variants(F.col(title))).alias("__i", "__title"), artist).select(request, "__i", "__title", F.posexplode(artist_variants(F.col(artist))).alias("__j", "__artist"))
    songs = known_by(known, F.concat_ws("|", F.lower(trimmed(known_title)), F.lower(trimmed(known_artist))), target)
    hit = forms.withColumn("__key", F.concat_ws("|", "__title", "__artist")).join(songs, "__key")
    first = hit.groupBy(request).agg(F.min(F.struct("__i", "__j", "__target")).alias("__hit"))
    return first.select(request, F.col("__hit.__target").alias(target), (F.col("__hit.__i") * 1000 + F.col("__hit.__j")).alias("attempt"))


def work_left(songs: DataFrame, path: str, records: DataFrame, version: int) -> DataFrame:
    """Songs without a record of the version that hasn't failed."""
    done = records.filter((F.col("version") == version) & ~F.coalesce(F.col("failed"), F.lit(False)))
    return songs.join(done.select(path), path, "left_anti")


def current_cache(songs: DataFrame, cache: DataFrame, stamp: list[str]) -> DataFrame:
    """Cached rows that are of a song as it is now: all of the stamp's columns agree."""
    return cache.join(songs.select(*stamp).distinct(), stamp, "left_semi")


def album_hints(songs: DataFrame, song: str, album: str, artist: str, hints: DataFrame, hint_album: str, hint_artist: str) -> DataFrame:
    """Ids of songs of a hinted album whose artist contains the hinted one (a blank one fits all)."""
    key = lambda c: F.lower(trimmed(F.coalesce(F.col(c), F.lit(""))))
    named = hints.select(key(hint_album).alias("__album"), key(hint_artist).alias("__hint")).filter("__album <> ''").distinct()
    near = songs.withColumn("__album", key(album)).join(named, "__album")
    return near.filter((F.col("__hint") == "") | F.contains(key(artist), F.col("__hint"))).select(song).distinct()


def direct_children(entries: DataFrame, url: str, base: str, seq: str) -> DataFrame:
    """Entries right below a folder on its own server, each name once, the last of a name.

    Queries and fragments aren't files; a name that hides a slash, or goes up, isn't a child.
    """
    from urllib.parse import urlsplit

    at = urlsplit(base)
    origin, above = f"{at.scheme}://{at.netloc}", [p for p in at.path.split("/") if p]
    inside = F.col(url).startswith(origin + "/") & ~F.col(url).rlike("[?#]")
    rest = F.split(F.regexp_replace(F.substring(F.col(url), len(origin) + 2, 1 << 30), "/$", ""), "/")
    decoded = F.transform(rest, lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
    listed = entries.filter(inside).withColumn("__parts", decoded).filter(F.size("__parts") == len(above) + 1)
    for i, part in enumerate(above):
        listed = listed.filter(F.get("__parts", F.lit(i)) == part)
    name = F.get("__parts", F.lit(len(above)))
    fit = listed.withColumn("name", name).filter((F.col("name") != "") & ~F.col("name").rlike(r"[/\\\x00]") & ~F.col("name").isin(".", ".."))
    kept = [c for c in entries.columns if c != "name"]
    last = fit.groupBy("name", F.col(url).endswith("/").alias("folder")).agg(F.max_by(F.struct(*kept), seq).alias("__row"))
    return last.select("name", "folder", "__row.*")
