"""What to play next: weights of plays and hints, sound alike, transitions, keys and tempos, additive scores, holdouts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cantata.functions.text import fnv1a, trimmed
from cantata.operators.checkpoints import checkpointed
from cantata.operators.ranking import logistic_with_prior
from cantata.operators.windows import running_sum

# How strongly each pitch class belongs to a major and a minor key, from the tonic on.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)

# The plays that a hint stands for, and the parts of an additive score.
HINT_PLAYS = {"loved": 3.0, "queued": 1.0, "album": 0.5}
GENRE_FIT, SAME_ARTIST, SAME_ALBUM, NEW_ARTIST, HEARD = 6.0, 2.0, 1.0, 1.0, 20.0


def play_weights(plays: DataFrame, song: str, day: str, n: str, today) -> DataFrame:
    """song, season (the last 90 days, the last 14 counted twice) and past (the rest of the year before)."""
    age = F.date_diff(F.lit(today), F.col(day))
    factor = F.when(age.between(0, 13), 2).when(age.between(14, 89), 1).otherwise(0)
    recent = plays.filter(age.between(0, 364) & (F.col(n) > 0))
    return recent.groupBy(song).agg(F.sum(F.col(n) * factor).alias("season"), F.sum(F.when(age >= 90, F.col(n)).otherwise(0)).alias("past"))


def plays_of_songs(songs: DataFrame, source: str, key: Column, by_source: DataFrame, by_key: DataFrame) -> DataFrame:
    """songs with ``plays`` by their source, or else by artist and title; those without any are left out.

    by_source and by_key: (key, plays), one row a key.
    """
    first = by_source.toDF("__s", "__n1")
    second = by_key.toDF("__k", "__n2")
    joined = songs.withColumn("__key", key).join(first, F.col(source) == F.col("__s"), "left").join(second, F.col("__key") == F.col("__k"), "left")
    return joined.withColumn("plays", F.coalesce("__n1", "__n2")).filter("plays IS NOT NULL").drop("__s", "__n1", "__k", "__n2", "__key")


def hint_plays(loved: DataFrame, liked: DataFrame, queued: DataFrame, albums: DataFrame, song: str, reward: str, age_days: Column) -> DataFrame:
    """song and the plays that hints stand for: a rewarded listen counts by its reward, twice within 14 days, not from 90 on."""
    listens = liked.filter((F.col(reward) > 0) & (age_days < 90)).select(song, (F.col(reward) * F.when(age_days < 14, 2).otherwise(1)).cast("double").alias("plays"))
    flat = lambda df, kind: df.select(song, F.lit(HINT_PLAYS[kind]).alias("plays"))
    every = listens.union(flat(loved, "loved")).union(flat(queued, "queued")).union(flat(albums.distinct(), "album"))
    return every.groupBy(song).agg(F.sum("plays").alias("plays"))


def octaves(a: Column, b: Column) -> Column:
    """How far apart two tempos are, half and double time being the same: 0 to 0.5."""
    apart = F.abs(F.log2(a / b)) % 1
    return F.least(apart, 1 - apart)


def sound_alike(p: Column, q: Column, weights: list[float], tempo_p: Column, tempo_q: Column, tempo_weight: float = 0.1) -> Column:
    """1 for points that are the same, towards 0; an unknown tempo counts as two random ones'."""
    apart = F.aggregate(
        F.zip_with(F.array(*map(F.lit, weights)), F.zip_with(p, q, lambda x, y: (x - y).cast("double")), lambda w, d: w * d * d), F.lit(0.0), lambda s, x: s + x
    )
    known = (F.coalesce(tempo_p, F.lit(0)) > 0) & (F.coalesce(tempo_q, F.lit(0)) > 0)
    tempo = F.when(known, F.least(F.lit(9.0), F.pow(octaves(tempo_p, tempo_q) / 0.1, F.lit(2.0)))).otherwise(2.0)
    return F.exp(-(apart + tempo_weight * tempo) / 2)


def wheel_place(tonic: Column, major: Column) -> Column:
    """The place of a key on the circle of fifths; a minor key shares its relative major's."""
    return (7 * F.when(major, tonic % 12).otherwise((tonic + 3) % 12) + 7) % 12


def keys_agree(tonic_a: Column, major_a: Column, tonic_b: Column, major_b: Column) -> Column:
    """The same place on the wheel, or next to each other and of one mode."""
    apart = F.abs(wheel_place(tonic_a, major_a) - wheel_place(tonic_b, major_b))
    return (apart == 0) | ((major_a == major_b) & apart.isin(1, 11))


def transition(a: dict[str, Column], b: dict[str, Column], tempo: float = 1.5, energy: float = 1.5, key: float = 0.5) -> Column:
    """How well b follows a (tempo, sure, energy, tonic, major, strength): leaps of tempo and energy cost, keys that agree gain."""
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    leap = F.pow(F.lit(2.0), octaves(a["tempo"], b["tempo"])) - 1
    cost = F.when((a["tempo"] > 0) & (b["tempo"] > 0), share(F.least(a["sure"], b["sure"]) / 0.5) * share((leap - 0.03) / 0.09)).otherwise(0.0)
    change = share((F.abs(a["energy"] - b["energy"]) - 0.3) / 1.2)
    sure_keys = (a["strength"] >= 0.5) & (b["strength"] >= 0.5)
    gain = F.when(sure_keys & keys_agree(a["tonic"], a["major"], b["tonic"], b["major"]), key).otherwise(0.0)
    return gain - tempo * cost - energy * change


def best_key(chroma: Column) -> Column:
    """tonic, major and strength of the key whose profile twelve pitch strengths follow best; ties: lower tonic, major."""
    mean = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x) / 12
    centred = F.transform(chroma, lambda x: x.cast("double") - mean)
    size = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x)
    candidates = []
    for tonic in range(12):
        for major, profile in ((True, MAJOR_PROFILE), (False, MINOR_PROFILE)):
            own = [profile[(pitch - tonic) % 12] - sum(profile) / 12 for pitch in range(12)]
            product = F.aggregate(F.zip_with(centred, F.array(*map(F.lit, own)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            strength = product / F.greatest(F.sqrt(size * sum(x * x for x in own)), F.lit(1e-12))
            candidates.append(F.struct(strength.alias("strength"), F.lit(-tonic).alias("before"), F.lit(major).alias("major")))
    best = F.array_max(F.array(*candidates))
    return F.struct((-best["before"]).alias("tonic"), best["major"].alias("major"), best["strength"].alias("strength"))


def combined_tempo(bpm_a: Column, sure_a: Column, bpm_b: Column, sure_b: Column) -> Column:
    """bpm and confidence of two windows' tempos: within 3 per cent their weighted mean, else the surer one at 0.8.

    One window without a beat (null) leaves the other's at 0.8; none gives 0 and 0.
    """
    pick = lambda bpm, sure: F.struct(bpm.cast("double").alias("bpm"), sure.cast("double").alias("confidence"))
    first = sure_a >= sure_b
    best, best_sure, other = F.when(first, bpm_a).otherwise(bpm_b), F.greatest(sure_a, sure_b), F.when(first, bpm_b).otherwise(bpm_a)
    mean = (bpm_a * sure_a + bpm_b * sure_b) / F.greatest(sure_a + sure_b, F.lit(1e-9))
    return (
        F.when(bpm_a.isNull() & bpm_b.isNull(), pick(F.lit(0), F.lit(0)))
        .when(bpm_a.isNull(), pick(bpm_b, sure_b * 0.8))
        .when(bpm_b.isNull(), pick(bpm_a, sure_a * 0.8))
        .when(F.abs(other / best - 1) < 0.03, pick(mean, best_sure))
        .otherwise(pick(best, best_sure * 0.8))
    )


def additive_scores(session: DataFrame, candidates: DataFrame, who: str, back: str, song: str, artist: str, album: str, genres: str, window: int = 12) -> DataFrame:
    """candidates with ``score``: how well each goes on a listener's session (back: 0 for the song that plays, then backwards).

    Genres of the last ``window`` songs count by 0.75 a step. The playing song's artist and album add to it, an artist new to the
    session too; one heard already costs the more the nearer and the oftener it was, and a song heard 20 and its recency
    besides. A session's sums are a row for each genre, artist and song, joined by equality.
    """
    near = session.filter((F.col(back) < window) & (F.size(genres) > 0)).withColumn("__w", F.pow(F.lit(0.75), F.col(back)))
    taste = near.select(who, F.explode(genres).alias("__genre"), (F.col("__w") / F.size(genres)).alias("__w")).groupBy(who, "__genre").agg(F.sum("__w").alias("__gw"))
    total = near.groupBy(who).agg(F.sum("__w").alias("__total"))
    artists = session.filter(F.col(artist) != "").groupBy(who, artist).agg(F.min(back).alias("__near"), F.count(F.lit(1)).alias("__plays"))
    heard = session.filter(F.col(back) > 0).groupBy(who, song).agg(F.min(back).alias("__back"))
    length = session.groupBy(who).agg(F.max(back).alias("__oldest"))
    playing = session.filter(F.col(back) == 0).select(who, F.col(artist).alias("__artist"), F.col(album).alias("__album"))
    wanted = candidates.select(who, song, F.explode(F.array_distinct(genres)).alias("__genre"))
    fit = wanted.join(taste, [who, "__genre"]).groupBy(who, song).agg(F.sum("__gw").alias("__fit"))
    c = candidates
    for other, on in ((total, [who]), (fit, [who, song]), (artists, [who, artist]), (heard, [who, song]), (length, [who]), (playing, [who])):
        c = c.join(other, on, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    score = F.when(F.col("__total") > 0, GENRE_FIT * F.least(F.lit(1.0), zero("__fit") / F.col("__total"))).otherwise(0.0)
    same = lambda a, b: (F.col(a) != "") & F.coalesce(F.col(a) == F.col(b), F.lit(False))
    score += F.when(same(artist, "__artist"), SAME_ARTIST).otherwise(0.0) + F.when(same(album, "__album"), SAME_ALBUM).otherwise(0.0)
    tired = -6 * F.pow(F.lit(0.7), F.col("__near")) - 1.5 * F.least(F.lit(4), F.col("__plays"))
    fresh = F.when(F.col(artist) == "", 0.0).when(F.col("__near").isNull(), NEW_ARTIST).otherwise(tired)
    score += F.when(F.col("__back").isNotNull(), -HEARD - (F.col("__oldest") - F.col("__back"))).otherwise(fresh)
    return c.withColumn("score", score).select(*candidates.columns, "score")


def temporal_holdout(outcomes: DataFrame, lead: Column, order: list, least: int = 40) -> DataFrame:
    """Adds ``tested``: the latest quarter, ten at least; nothing is tested of fewer outcomes than ``least``. lead, a number, begins the order."""
    n = outcomes.agg(F.count(F.lit(1)).alias("__n"))  # one row
    placed = running_sum(outcomes, [], lead, order, F.lit(1).cast("long"), "__at").join(F.broadcast(n))
    tested = F.greatest(F.lit(10), F.floor(F.col("__n") / 4))
    return placed.withColumn("tested", (F.col("__n") >= least) & (F.col("__at") > F.col("__n") - tested)).drop("__n", "__at")


def grouped_auc(df: DataFrame, group: str, score: str, label: Column) -> DataFrame:
    """group and ``auc``: the chance that a row with the label scores above one without, ties half; null if either is absent.

    Rows are counted by score first; along a group go its distinct scores.
    """
    counts = df.groupBy(group, F.col(score).alias("__s")).agg(F.sum(label.cast("long")).alias("__p"), F.sum((~label).cast("long")).alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("__w", F.col("__p") * (2 * below + F.col("__n"))).groupBy(group).agg(F.sum("__w").alias("__w"), F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    return sums.select(group, F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__w") / (2 * F.col("__p") * F.col("__n"))).alias("auc"))


def champions(outcomes: DataFrame, who: str, at: str, item: str, features: list[str], kept: Column, weight: str, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """For each listener, may weights that were learned replace the starting ones (all 1)? The decision, and the weights of those that win.

    The latest quarter of the outcomes, ten at least, is tested with weights learned from the rest. Learned ones win if they
    rank it at least as well; then they are learned anew from all. Decision: who, outcomes, tested, starting and learned (the
    two AUCs, null where either kind is absent or there are fewer outcomes than least), wins. Weights: who, feature,
    coefficient. at is a number and, with item, a total order.
    """
    counts = outcomes.groupBy(F.col(who).alias("__who")).agg(F.count(F.lit(1)).alias("__n"))
    same = F.col(who).eqNullSafe(F.col("__who"))
    tested = F.greatest(F.lit(10), F.floor(F.col("__n") / 4))
    marked = running_sum(outcomes.withColumn("__kept", kept), [who], F.col(at), [F.col(at), F.col(item)], F.lit(1).cast("long"), "__at").join(counts, same).drop("__who")
    marked = checkpointed(marked.withColumn("__tested", F.col("__at") > F.col("__n") - tested).filter(F.col("__n") >= least))
    fitted = lambda rows: logistic_with_prior(rows.withColumn("__label", F.col("__kept").cast("int")), who, features, "__label", weight)
    earlier = checkpointed(fitted(marked.filter("NOT __tested")))
    wide = earlier.groupBy(F.col(who).alias("__who")).agg(*[F.max(F.when(F.col("feature") == f, F.col("coefficient"))).alias(f"__c{i}") for i, f in enumerate(features)])
    latest = marked.filter("__tested").join(wide, same)
    scored = latest.select(who, "__kept", sum((F.col(f).cast("double") for f in features), F.lit(0.0)).alias("__start"), sum((F.col(f) * F.col(f"__c{i}") for i, f in enumerate(features)), F.lit(0.0)).alias("__learned"))
    starting, learned = (grouped_auc(scored, who, c, F.col("__kept")).toDF(f"__{n}", n) for c, n in (("__start", "starting"), ("__learned", "learned")))
    told = counts.join(starting, F.col("__who").eqNullSafe(F.col("__starting")), "left").join(learned, F.col("__who").eqNullSafe(F.col("__learned")), "left")
    enough = F.col("__n") >= least
    wins = F.coalesce(F.col("learned") >= F.col("starting"), F.lit(False))
    decision = checkpointed(told.select(F.col("__who").alias(who), F.col("__n").alias("outcomes"), F.when(enough, tested).alias("tested"), "starting", "learned", wins.alias("wins")))
    winners = decision.filter("wins").select(F.col(who).alias("__who"))
    return decision, fitted(marked.join(winners, same, "left_semi"))


def hashed_feature(name: Column, dimensions: int = 4096) -> Column:
    """index and sign of a feature: the lowest bits of its hash, and its highest one."""
    return _feature_of(fnv1a(name), dimensions)


def _feature_of(h: Column, dimensions: int) -> Column:
    return F.struct((h % dimensions).cast("int").alias("index"), F.when(h >= 1 << 31, -1).otherwise(1).alias("sign"))


def hashed_features(names: Column, dimensions: int = 4096) -> Column:
    """hashed_feature of each of an array's names; every name is hashed once."""
    return F.transform(F.transform(names, fnv1a), lambda h: _feature_of(h, dimensions))


def first_feedback(picks: DataFrame, feedback: DataFrame, who: str, item: str, at: str, keep: int = 200) -> DataFrame:
    """Each pick with its first feedback (``label_at`` and the rest): that after it, and before the item is picked again.

    Of the picks that still wait for theirs, the oldest is forgotten when there are more than ``keep``; a pick made again waits
    anew. Each listener's rows pass a task in order (of at one time picks come first, then by item), which holds the waiting
    picks of one listener and nothing else.
    """
    rest = [c for c in feedback.columns if c not in (who, item, at)]
    a = picks.select(who, item, at, F.lit(0).alias("__kind"), *[F.lit(None).cast(feedback.schema[c].dataType).alias(c) for c in rest])
    both = a.unionByName(feedback.select(who, item, at, F.lit(1).alias("__kind"), *rest))
    kinds = {f.name: f.dataType for f in both.schema}
    schema = T.StructType([T.StructField(n, kinds[c]) for n, c in ((who, who), (item, item), ("picked_at", at), ("label_at", at), *zip(rest, rest, strict=True))])

    def run(batches):
        shape, waiting, listener = to_arrow_schema(schema), {}, ()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if listener != (row[who],):
                    waiting, listener = {}, (row[who],)
                picked = waiting.pop(row[item], None)
                if row["__kind"] == 0:
                    waiting[row[item]] = (row[at],)
                    if len(waiting) > keep:
                        del waiting[next(iter(waiting))]
                elif picked:
                    out.append({who: row[who], item: row[item], "picked_at": picked[0], "label_at": row[at], **{c: row[c] for c in rest}})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return both.repartition(who).sortWithinPartitions(who, at, "__kind", item).mapInArrow(run, schema)


def scrobbles(plays: DataFrame, instance: str, title: str, artist: str, seconds: str, duration: str, started: str) -> DataFrame:
    """Playback instances heard for half of their length or four minutes, whichever is less: once each, with its start.

    Only of titles with an artist that last more than 30 seconds. An aggregate, so it also runs on a stream.
    """
    named = plays.filter((trimmed(title) != "") & (trimmed(artist) != "") & (F.col(duration) > 30))
    heard = named.groupBy(instance, title, artist, duration).agg(F.sum(seconds).alias("heard"), F.min(started).alias("started"))
    return heard.filter(F.col("heard") >= F.least(F.col(duration) / 2, F.lit(240)))


def settled_groups(members: DataFrame, group: str, settled: Column, good: Column) -> DataFrame:
    """Groups all of whose members have settled, with their number and how many came out well."""
    counted = members.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count(F.when(settled, 1)).alias("__settled"), F.count(F.when(settled & good, 1)).alias("good"))
    return counted.filter("members = __settled").drop("__settled")
