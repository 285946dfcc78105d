"""The mixes of a day for every listener: which songs each may hold, the songs it gets, and which mixes are given."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cantata.operators.checkpoints import checkpointed
from cantata.operators.ordering import shuffle_key
from cantata.operators.signals import DISCOVERIES

# Songs that a library must have, days that a song is fresh, songs of the smallest mix and of a whole one, and an
# artist's share of it; how many mixes there are, of genres, decades and artists too; what makes a kind worth a mix; songs that
# a mix is chosen from.
LEAST_LIBRARY, FRESH_DAYS, LEAST_SONGS, SONGS, ARTIST_SHARE = 30, 30, 20, 40, 0.2
MOST_MIXES, MOST = 10, {"genre": 5, "decade": 2, "artist": 3}
LEAST_GENRE, LEAST_DECADE, LEAST_ARTIST, LEAST_PLAYED, OVERLAP = 12, 25, 3, 8, 0.6
POOL, POOL_HEARD, POOL_SEEDS = 1500, 750, 4
# Fixed values of composing: songs chosen at a time, songs that count for the genres and how they fade, songs between two of
# an artist; what genre, artist, plays, earlier mixes, a new artist and the artist of the mix are worth; how an artist tires.
REFILL, WINDOW, FADE, GAP = 6, 12, 0.75, 4
FIT, SAME_ARTIST, HEARD, USED, NEW_ARTIST, ANCHOR, CHANCE = 6.0, 2.0, 2.5, 1.5, 1.0, 2.0, 1.5
TIRED, TIRED_FADE, PLAYED_TOO, PLAYED_MOST = 6.0, 0.7, 1.5, 4
#: Artists of a listener that mixes are tried for in the first round; each further round takes five times as many.
FIRST_ARTISTS = 12

KINDS = ["favorites", "genre", *DISCOVERIES, "decade", "artist"]
SONG = ["who", "song", "artist", "families", "year", "added", "plays", "past"]


def with_families(songs: DataFrame) -> DataFrame:
    """A song without a genre takes the family that most of its artist's songs have; of equals the first by name."""
    votes = songs.select("who", "artist", F.explode("families").alias("__f")).groupBy("who", "artist", "__f").count()
    top = votes.groupBy(F.col("who").alias("__w"), F.col("artist").alias("__a")).agg(F.min_by("__f", F.struct(-F.col("count"), "__f")).alias("__top"))
    told = songs.join(top, F.col("who").eqNullSafe(F.col("__w")) & F.col("artist").eqNullSafe(F.col("__a")), "left")
    own = F.when((F.coalesce(F.size("families"), F.lit(0)) <= 0) & F.col("__top").isNotNull(), F.array("__top")).otherwise(F.coalesce("families", F.array().cast("array<string>")))
    return told.withColumn("families", own).select(*songs.columns)


def _ranked(stats: DataFrame, order: list[Column], name: str = "rank", by: tuple[str, ...] = ("who",)) -> DataFrame:
    return stats.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def listeners(songs: DataFrame) -> DataFrame:
    """songs (with families) of the listeners that have enough of them, with counts of the whole library: __n, __played, __tagged, __max."""
    known = songs.groupBy("who").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(F.when(F.col("plays") > 0, 1)).alias("__played"),
        F.count(F.when(F.size("families") > 0, 1)).alias("__tagged"),
        F.greatest(F.max("plays"), F.lit(0.0)).alias("__max"),
    )
    return songs.join(known.filter(F.col("__n") >= LEAST_LIBRARY), "who")


def _pool(rows: DataFrame, kind: str, key: Column, rank: Column, lead: Column | None = None, core: Column | None = None, shuffled: bool = True) -> DataFrame:
    """Songs that a mix may have: core ones may begin it, the one of the greatest lead first, then in the day's order (or by song)."""
    lead, core = F.col("plays") if lead is None else lead, F.lit(True) if core is None else core
    named = [F.lit(kind).alias("kind"), key.cast("string").alias("key"), rank.cast("int").alias("rank"), lead.cast("double").alias("lead"), core.alias("core"), F.lit(shuffled).alias("shuffled")]
    return rows.select("who", "song", "artist", "families", "plays", "__max", (F.col("__tagged") * 2 >= F.col("__n")).alias("mostly"), *named)


def pools(songs: DataFrame, day) -> DataFrame:
    """The songs that may be in each mix but those of artists; rank is that of a key among its kind's.

    songs: as listeners gives them; day: the date the mixes are for. What is the listener's as a whole (counts,
    favourite families) is aggregated first and joined back by equality. A song may be in a pool twice, once as no core.
    """
    each = songs.withColumn("family", F.explode("families")).withColumn("__share", F.lit(1.0) / F.size("families"))
    families = each.groupBy("who", "family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("plays") * F.col("__share")).alias("heard"))
    none = F.lit("")

    played = _ranked(songs.filter((F.col("plays") > 0) & (F.col("__played") >= LEAST_PLAYED)), [F.desc("plays"), F.col("song")], "__at").filter("__at <= 100")
    weights = played.filter("__at <= 50").select("who", F.explode("families").alias("family"), (F.col("plays") / F.size("families")).alias("w")).groupBy("who", "family").agg(F.sum("w").alias("w"))
    near = _ranked(weights, [F.desc("w"), F.col("family")]).filter("rank <= 3").select("who", "family")
    alike = each.join(near, ["who", "family"])
    unsaid = songs.join(played.filter("__at <= 50").groupBy("who").agg(F.max(F.size("families")).alias("__most")).filter("__most <= 0").select("who"), "who", "left_semi")
    beside = _pool(alike.select(*songs.columns).unionByName(unsaid.select(*songs.columns)), "favorites", none, F.lit(1), core=F.lit(False), shuffled=False)
    favourites = _pool(played, "favorites", none, F.lit(1), shuffled=False).unionByName(beside)

    genres = _ranked(families.filter(F.col("n") >= LEAST_GENRE), [F.desc(F.col("heard") + 0.01 * F.col("n")), F.col("family")])
    core = each.join(genres.select("who", "family", "n", "rank"), ["who", "family"])
    few = core.filter((F.col("n") < LEAST_SONGS) & (F.col("artist") != "")).select("who", "artist", "family", "rank").distinct()
    genre = _pool(core, "genre", F.col("family"), F.col("rank")).unionByName(_pool(songs.join(few, ["who", "artist"]), "genre", F.col("family"), F.col("rank"), core=F.lit(False)))

    is_fresh = F.date_diff(F.lit(day), F.col("added")) < FRESH_DAYS
    count = songs.groupBy("who").agg(F.count(F.when(is_fresh, 1)).alias("__fresh"))
    fresh = _pool(songs.filter(is_fresh).join(count, "who").filter(F.col("__fresh") * 2 <= F.col("__n")), "fresh", none, F.lit(1), F.unix_date(F.col("added").cast("date")), shuffled=False)
    forgotten = _pool(songs.filter((F.col("past") > 0) & (F.col("plays") <= 0)), "rediscover", none, F.lit(1), F.col("past"), shuffled=False)
    liked = _ranked(families.filter("heard > 0"), [F.desc("heard"), F.col("family")]).filter("rank <= 3").select("who", "family")
    discover = _pool(each.join(liked, ["who", "family"]).filter((F.col("plays") <= 0) & (F.coalesce("past", F.lit(0)) <= 0)), "discover", none, F.lit(1))

    dated = F.col("year").between(1900, F.year(F.lit(day)))
    decades = each.filter(dated).withColumn("decade", F.floor(F.col("year") / 10) * 10)
    leading = decades.groupBy("who", "decade", "family").agg(F.sum((1 + F.col("plays")) * F.col("__share")).alias("w"))
    leading = _ranked(leading, [F.desc("w"), F.col("family")], by=("who", "decade")).filter("rank <= 2").select("who", "decade", "family")
    of_decade = decades.join(leading, ["who", "decade", "family"]).select(*songs.columns, "decade").distinct()
    heard = songs.filter(dated).groupBy("who", (F.floor(F.col("year") / 10) * 10).alias("decade")).agg(F.sum("plays").alias("heard"), F.count(F.lit(1)).alias("n"))
    size = of_decade.groupBy("who", "decade").agg(F.count(F.lit(1)).alias("__core")).filter(F.col("__core") >= LEAST_DECADE)
    ranked = _ranked(heard.join(size, ["who", "decade"]), [F.desc("heard"), F.desc("n"), F.desc("decade")])
    decade = _pool(of_decade.join(ranked.select("who", "decade", "rank"), ["who", "decade"]), "decade", F.col("decade"), F.col("rank"))
    return reduce(DataFrame.unionByName, [favourites, genre, fresh, forgotten, discover, decade])


def anchors(songs: DataFrame) -> DataFrame:
    """who, anchor, rank: the artists that may have mixes of their own, those played most first."""
    artists = songs.filter("artist != ''").groupBy("who", "artist").agg(F.count(F.lit(1)).alias("n"), F.sum("plays").alias("heard"))
    return _ranked(artists.filter(F.col("n") >= LEAST_ARTIST), [F.desc("heard"), F.desc("n"), F.col("artist")]).select("who", F.col("artist").alias("anchor"), "rank")


def artist_pools(songs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The songs of the mixes of wanted artists (who, anchor, rank): their own, those of their families, or, without any, all without."""
    own = songs.join(wanted.withColumnRenamed("anchor", "artist"), ["who", "artist"])
    tell = own.groupBy("who", "artist", "rank").agg(F.array_distinct(F.flatten(F.collect_set("families"))).alias("__f"))
    keyed = tell.select("who", F.col("artist").alias("anchor"), "rank", F.explode(F.when(F.size("__f") > 0, F.col("__f")).otherwise(F.array(F.lit(None).cast("string")))).alias("family"))
    each = songs.withColumn("__family", F.explode(F.when(F.size("families") > 0, F.col("families")).otherwise(F.array(F.lit(None).cast("string")))))
    beside = each.join(keyed.withColumnRenamed("who", "__who"), (F.col("who") == F.col("__who")) & F.col("__family").eqNullSafe(F.col("family")))
    return _pool(own, "artist", F.col("artist"), F.col("rank")).unionByName(_pool(beside, "artist", F.col("anchor"), F.col("rank"), core=F.lit(False)))


def candidates(pool: DataFrame, day: str) -> DataFrame:
    """pool with each song once and ``seed`` (1 for the song that begins the mix), cut to POOL songs a mix; mixes too small go.

    Of a larger pool the first seeds stay, then those played most, then the day's sample. Each of these is a row number with a
    filter, so that a task hands on no more than POOL rows of a mix.
    """
    mix = ["who", "kind", "key", "rank"]
    once = pool.groupBy(*mix, "song").agg(*[F.first(c).alias(c) for c in ("artist", "families", "plays", "__max", "mostly", "shuffled")], F.max("core").alias("core"), F.max(F.when(F.col("core"), F.col("lead"))).alias("lead"))
    once = checkpointed(once.withColumn("draw", shuffle_key(day, F.col("song").cast("string"))))  # read five times below
    sized = once.groupBy(*mix).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") >= LEAST_SONGS)
    place = lambda rows, order, name, most: rows.withColumn(name, F.row_number().over(Window.partitionBy(*mix).orderBy(*order))).filter(F.col(name) <= most)
    key = [*mix, "song"]
    seeds = place(once.filter("core"), [F.desc("lead"), F.when(F.col("shuffled"), F.col("draw")), F.col("song")], "seed", POOL_SEEDS).select(*key, "seed")
    heard = place(once.filter("plays > 0"), [F.desc("plays"), F.col("song")], "__heard", POOL)
    rest = place(once.filter("NOT plays > 0 OR plays IS NULL"), [F.col("draw"), F.col("song")], "__rest", POOL)
    both = heard.unionByName(rest, allowMissingColumns=True).unionByName(once.join(seeds.select(*key), key, "left_semi"), allowMissingColumns=True)
    both = both.groupBy(*once.columns).agg(F.max("__heard").alias("__heard"), F.max("__rest").alias("__rest")).join(seeds, key, "left").join(sized, mix)
    tier = F.when(F.col("seed").isNotNull(), 0).when(F.col("__heard").isNotNull() & ((F.col("__size") <= POOL) | (F.col("__heard") <= POOL_HEARD)), 1).when(F.col("__rest").isNotNull(), 2)
    cut = both.withColumn("__tier", tier).filter("__tier IS NOT NULL")
    return place(cut, [F.col("__tier"), F.coalesce("seed", "__heard", "__rest"), F.col("song")], "__at", POOL).select(*once.columns, "seed")


def composed(songs: list, artists: list, families: list, plays, top: float, draws, used: set, anchor: str, seed: int) -> list[int]:
    """The songs of one mix in order, as places in the lists: chosen REFILL at a time by score, as if it played on.

    A song scores by how its genres fit the last ones of the mix, by plays, and by an artist new to the mix or tired in it;
    songs of earlier mixes cost. No artist returns within GAP songs while others fit, plays twice in a row, or takes more than its
    share.
    """
    names, n = sorted({f for fs in families for f in fs or []}), len(songs)
    has = np.zeros((n, len(names)))
    for i, fs in enumerate(families):
        has[i, [names.index(f) for f in fs or []]] = 1
    size, by = np.maximum(1, has.sum(axis=1)), np.array([a or "" for a in artists], dtype=object)
    target = min(SONGS, n)
    cap = max(2, math.ceil(target * ARTIST_SHARE))
    fixed = np.where((plays > 0) & (top > 0), HEARD * np.log1p(np.maximum(plays, 0)) / math.log1p(top or 1), 0.0)
    fixed = fixed - USED * np.array([s in used for s in songs]) + ANCHOR * ((by == anchor) & (anchor != "")) + SAME_ARTIST * ((by == by[seed]) & (by != ""))
    mix, counts, refill = [seed], Counter([by[seed]]), 0
    while len(mix) < target:
        weights, total = np.zeros(len(names)), 0.0
        for back, i in enumerate(reversed(mix[-WINDOW:])):
            if has[i].any():
                total += FADE**back
                weights += FADE**back * has[i] / size[i]
        score = fixed + CHANCE * ((draws * 2654435761 + refill * 40503) % (1 << 32)) / (1 << 32)
        if total > 0:
            score = score + FIT * np.minimum(1.0, has @ weights / total)
        apart = {by[i]: back for back, i in reversed(list(enumerate(reversed(mix))))}
        played = Counter(by[i] for i in mix)
        mood = {a: -TIRED * TIRED_FADE ** apart[a] - PLAYED_TOO * min(PLAYED_MOST, played[a]) if a in apart else NEW_ARTIST for a in set(by)} | {"": 0.0}
        score = score + np.array([mood[a] for a in by])
        open_ = np.ones(n, bool)
        open_[mix] = False
        open_ &= np.array([counts[a] < cap for a in by])
        latest, picked, chosen = [by[i] for i in mix], set(), []
        while len(chosen) < min(REFILL, target - len(mix)) and open_.any():
            for barred in (set(latest[max(0, len(latest) - (GAP - 1)) :]) | picked, {latest[-1]}, set()):
                fit = open_ & ~np.isin(by, list(barred - {""}))
                if fit.any():
                    break
            best = int(np.argmax(np.where(fit, score, -np.inf)))
            open_[best] = False
            chosen.append(best)
            latest.append(by[best])
            picked |= {by[best]} - {""}
        added = 0
        for i in chosen:
            if counts[by[i]] < cap and not (by[i] and by[i] == by[mix[-1]]):
                mix.append(i)
                counts[by[i]] += 1
                added += 1
        refill += 1
        if not added:
            break
    return mix


def _takes(given: list[tuple[str, str, set]], kind: str, key: str, mostly: bool) -> bool:
    """May a mix of this kind come still?"""
    if len(given) >= MOST_MIXES or sum(k == kind for k, _, _ in given) >= MOST.get(kind, 1):
        return False
    return kind != "artist" or (all(x != key for _, x, _ in given) and (not mostly or sum(k != "artist" for k, _, _ in given) < 3))


def _apart(given: list[tuple[str, str, set]], kind: str, songs: set) -> bool:
    """Shares it at most OVERLAP of the smaller one's songs with each that is given? Discoveries are compared among themselves."""
    same = [x for k, _, x in given if (k in DISCOVERIES) == (kind in DISCOVERIES)]
    return all(len(x & songs) <= OVERLAP * min(len(x), len(songs)) for x in same)


def given_mixes(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """who, kind, key, turn, place, song: candidates to the mixes that are given, one after another.

    before: what was given in an earlier round. A listener's mixes pass a task in order; it holds the candidates of one and the
    songs of those given, MOST_MIXES at most.
    """
    kind_of = rows.schema["song"].dataType.simpleString()
    tried = rows.withColumn("turn", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    if before is not None:
        tried = tried.unionByName(before.select("who", "song", "kind", "key", F.lit(0).alias("turn"), F.col("turn").alias("rank")), allowMissingColumns=True)
    columns = ["who", "turn", "rank", "kind", "key", "song", "artist", "families", "plays", "__max", "mostly", "draw", "seed"]
    who_of = rows.schema["who"].dataType.simpleString()

    def run(batches):
        listener, given, used, mix, rows_ = (), [], set(), None, []

        def end():
            nonlocal rows_
            held, rows_ = rows_, []
            if not held:
                return
            _, turn, _, kind, key = mix
            if turn == 0:
                songs = {r["song"] for r in held}
                given.append((kind, key, songs))
                used.update(songs)
            elif _takes(given, kind, key, held[0]["mostly"]):
                songs = [r["song"] for r in held]
                plays = np.array([r["plays"] or 0.0 for r in held])
                seed = next(i for i, r in enumerate(held) if r["seed"] == 1)
                draws = np.array([r["draw"] for r in held], dtype=np.int64)
                places = composed(songs, [r["artist"] for r in held], [r["families"] for r in held], plays, held[0]["__max"], draws, used, key if kind == "artist" else "", seed)
                found = [songs[i] for i in places]
                if len(found) >= LEAST_SONGS and _apart(given, kind, set(found)):
                    given.append((kind, key, set(found)))
                    used.update(found)
                    for place, song in enumerate(found, 1):
                        yield {"who": mix[0], "kind": kind, "key": key, "turn": len(given), "place": place, "song": song}

        schema = to_arrow_schema(shape)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = (r["who"], r["turn"], r["rank"], r["kind"], r["key"])
                if now != mix:
                    out += end()
                    if listener != (r["who"],):
                        listener, given, used = (r["who"],), [], set()
                    mix = now
                rows_.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(list(end()), schema=schema)

    shape = T._parse_datatype_string(f"who {who_of}, kind string, key string, turn int, place int, song {kind_of}")
    ordered = tried.select(*columns).repartition("who").sortWithinPartitions("who", "turn", "rank", "kind", "key", "song")
    return ordered.mapInArrow(run, shape)


def library_mixes(songs: DataFrame, day) -> DataFrame:
    """who, kind, key, turn, place, song: every listener's mixes for a day. songs: SONG; day: a date.

    Artists' mixes come only where there are fewer than three others, or fewer than half of the songs have a genre: first those
    of the artists played most, then, in rounds, those of more, for listeners who have neither three of them nor all their mixes. Rows without a
    listener are nobody's songs.
    """
    filled = checkpointed(listeners(with_families(songs.filter("who IS NOT NULL").select(*SONG))))
    given = checkpointed(given_mixes(candidates(pools(filled, day), str(day))))
    asked = checkpointed(anchors(filled).join(filled.groupBy("who").agg(F.max(F.col("__tagged") * 2 >= F.col("__n")).alias("mostly")), "who"))
    low, high = 0, FIRST_ARTISTS
    while True:
        counts = given.select("who", "kind", "key").distinct().groupBy("who").agg(F.count(F.lit(1)).alias("__all"), F.count(F.when(F.col("kind") == "artist", 1)).alias("__own"))
        open_ = asked.filter(F.col("rank") > low).join(counts, "who", "left").na.fill(0, ["__all", "__own"])
        open_ = open_.filter((F.col("__all") < MOST_MIXES) & (F.col("__own") < MOST["artist"]) & ((F.col("__all") - F.col("__own") < 3) | ~F.col("mostly")))
        wanted = checkpointed(open_.filter(F.col("rank") <= high).select("who", "anchor", "rank"))
        if wanted.isEmpty():
            return given
        before = given.join(wanted.select("who").distinct(), "who", "left_semi")
        given = checkpointed(given.unionByName(given_mixes(candidates(artist_pools(filled, wanted), str(day)), before)))
        low, high = high, high * 5
