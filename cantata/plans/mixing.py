"""Ranking, sound and session queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantata.operators import mixing as mx
from cantata.plans.common import Registry

registry = Registry()
query = registry.query

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("""
WITH d AS (SELECT user_id, DATE '2024-01-28' - CAST(ts AS DATE) AS age FROM events)
SELECT user_id, CAST(sum(CASE WHEN age BETWEEN 0 AND 13 THEN 2 WHEN age BETWEEN 14 AND 89 THEN 1 ELSE 0 END) AS BIGINT) AS season, CAST(sum(CASE WHEN age >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS past
FROM d WHERE age BETWEEN 0 AND 364 GROUP BY 1""")
def play_weights(t):
    plays = t.events.select("user_id", F.to_date("ts").alias("day"), F.lit(1).alias("n"))
    return mx.play_weights(plays, "user_id", "day", "n", datetime.date(2024, 1, 28))


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1)
SELECT c_custkey, coalesce(a.n, b.n) AS plays FROM customer c LEFT JOIN a ON o_custkey = c_custkey LEFT JOIN b ON b.c_nationkey = c.c_nationkey WHERE coalesce(a.n, b.n) IS NOT NULL""")
def plays_of_songs(t):
    by_source = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").count()
    by_key = t.customer.filter("c_acctbal < 0").groupBy("c_nationkey").count()
    return mx.plays_of_songs(t.customer, "c_custkey", F.col("c_nationkey"), by_source, by_key).select("c_custkey", "plays")


@query("""
WITH e AS (SELECT user_id, event_type, DATE '2024-01-28' - CAST(ts AS DATE) AS age FROM events)
SELECT user_id, CAST(sum(p) AS DOUBLE) AS plays FROM (
  SELECT user_id, CASE WHEN age < 14 THEN 2 ELSE 1 END AS p FROM e WHERE event_type = 'view' AND age < 90 UNION ALL SELECT user_id, 3 FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, 1 FROM e WHERE event_type = 'click' UNION ALL SELECT DISTINCT user_id, 0.5 FROM e WHERE event_type = 'error') GROUP BY 1""")
def hint_plays(t):
    of = lambda kind: t.events.filter(F.col("event_type") == kind)
    liked = of("view").select("user_id", F.lit(1).alias("reward"), F.date_diff(F.lit(datetime.date(2024, 1, 28)), F.to_date("ts")).alias("age"))
    user = ["user_id"]
    return mx.hint_plays(of("purchase").select(*user), liked, of("click").select(*user), of("error").select(*user), "user_id", "reward", F.col("age"))


WEIGHTS = [0.5 / (i + 1) for i in range(8)]
POINT = "list_sum(list_transform(range(1, 9), lambda i: 0.5 / i * pow(CAST(a.embedding[i] - b.embedding[i] AS DOUBLE), 2)))"
TEMPO = "least(abs(log2({0})) % 1, 1 - abs(log2({0})) % 1)"
PAIRED = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(t):
    """Each vector beside the one of the next id."""
    later = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return t.embeddings.select("vec_id", "embedding").join(later, "vec_id")


@query(f"""
SELECT a.vec_id, round(exp(-({POINT} + 0.1 * CASE WHEN a.vec_id % 5 = 0 THEN 2 ELSE least(9, pow({TEMPO.format('(60.0 + a.vec_id % 90) / (60 + a.vec_id % 77)')} / 0.1, 2)) END) / 2), 6) AS alike {PAIRED}""")
def sound_alike(t):
    bpm = F.when(F.col("vec_id") % 5 != 0, 60.0 + F.col("vec_id") % 90)
    first = lambda c: F.slice(c, 1, 8)
    alike = mx.sound_alike(first("embedding"), first("next"), WEIGHTS, bpm, 60 + F.col("vec_id") % 77)
    return _pairs(t).select("vec_id", F.round(alike, 6).alias("alike"))


WHEEL = "(7 * CASE WHEN {1} THEN ({0}) % 12 ELSE (({0}) + 3) % 12 END + 7) % 12"
APART = "abs(" + WHEEL.format("a.vec_id", "a.vec_id % 2 = 0") + " - " + WHEEL.format("a.vec_id * 5 + 1", "a.vec_id % 3 = 0") + ")"


@query(f"""
SELECT a.vec_id, round(CASE WHEN a.vec_id % 4 > 0 AND ({APART} = 0 OR ((a.vec_id % 2 = 0) = (a.vec_id % 3 = 0) AND {APART} IN (1, 11))) THEN 0.5 ELSE 0 END
  - 1.5 * least(1, greatest(0, (a.vec_id % 10) / 10.0 / 0.5)) * least(1, greatest(0, (pow(2, {TEMPO.format('(60.0 + a.vec_id % 90) / (60 + a.vec_id % 77)')}) - 1 - 0.03) / 0.09))
  - 1.5 * least(1, greatest(0, (abs(CAST(a.embedding[1] AS DOUBLE) - CAST(b.embedding[1] AS DOUBLE)) * 4 - 0.3) / 1.2)), 6) AS follows {PAIRED}""")
def transition(t):
    v, strength = F.col("vec_id"), F.when(F.col("vec_id") % 4 > 0, 0.7).otherwise(0.2)
    energy = lambda c: F.col(c)[0].cast("double") * 4
    a = {"tempo": 60.0 + v % 90, "sure": (v % 10) / 10.0, "energy": energy("embedding"), "tonic": v, "major": v % 2 == 0, "strength": strength}
    b = {"tempo": 60 + v % 77, "sure": F.lit(1.0), "energy": energy("next"), "tonic": v * 5 + 1, "major": v % 3 == 0, "strength": strength}
    return _pairs(t).select("vec_id", F.round(mx.transition(a, b), 6).alias("follows"))


def _key_sql() -> str:
    rows = []
    for tonic in range(12):
        for major, profile in (("true", mx.MAJOR_PROFILE), ("false", mx.MINOR_PROFILE)):
            turned = ", ".join(f"CAST({profile[(p - tonic) % 12]} AS DOUBLE)" for p in range(12))
            rows.append(f"({tonic}, {major}, [{turned}])")
    return (
        f"WITH k(tonic, major, profile) AS (VALUES {', '.join(rows)}), x AS (SELECT vec_id, tonic, major, unnest(embedding[1:12]) AS c, unnest(profile) AS p FROM embeddings, k), "
        "s AS (SELECT vec_id, tonic, major, corr(CAST(c AS DOUBLE), p) AS strength FROM x GROUP BY ALL) "
        "SELECT vec_id, arg_max(tonic, strength) AS tonic, arg_max(major, strength) AS major, round(max(strength), 6) AS strength FROM s GROUP BY 1"
    )


@query(_key_sql())
def best_key(t):
    return t.embeddings.select("vec_id", mx.best_key(F.slice("embedding", 1, 12)).alias("k")).select("vec_id", "k.tonic", "k.major", F.round("k.strength", 6).alias("strength"))


@query("""
WITH w AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 100 + event_id % 9 END AS a, (event_id % 5) / 4.0 AS sa, CASE WHEN event_id % 11 > 0 THEN 102 + event_id % 4 END AS b, (event_id % 3) / 2.0 AS sb FROM events),
o AS (SELECT *, CASE WHEN sa >= sb THEN a ELSE b END AS best, CASE WHEN sa >= sb THEN b ELSE a END AS other FROM w)
SELECT event_id, round(CASE WHEN a IS NULL THEN coalesce(b, 0) WHEN b IS NULL THEN a WHEN abs(other / best - 1) < 0.03 THEN (a * sa + b * sb) / greatest(sa + sb, 1e-9) ELSE best END, 6) AS bpm,
  round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN sb * 0.8 WHEN b IS NULL THEN sa * 0.8 WHEN abs(other / best - 1) < 0.03 THEN greatest(sa, sb) ELSE greatest(sa, sb) * 0.8 END, 6) AS confidence FROM o""")
def combined_tempo(t):
    e = F.col("event_id")
    both = mx.combined_tempo(F.when(e % 7 > 0, 100 + e % 9), (e % 5) / 4.0, F.when(e % 11 > 0, 102 + e % 4), (e % 3) / 2.0)
    return t.events.select("event_id", both.alias("b")).select("event_id", F.round("b.bpm", 6).alias("bpm"), F.round("b.confidence", 6).alias("confidence"))


# a session is a user's events, the last one playing; candidates are the songs after the last twenty heard
@query(f"""
WITH s AS (SELECT user_id, {K} AS song, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events),
c AS (SELECT DISTINCT user_id, (song + 1) % 100 AS song FROM s WHERE back < 20),
g AS (SELECT user_id, 'g' || unnest([song % 7, 7 + song % 3]) AS genre, pow(0.75, back) / 2 AS w FROM s WHERE back < 12),
gw AS (SELECT user_id, genre, sum(w) AS w FROM g GROUP BY ALL), tot AS (SELECT user_id, sum(w) AS total FROM g GROUP BY 1),
ar AS (SELECT user_id, song % 40 AS artist, min(back) AS near, count(*) AS plays FROM s GROUP BY ALL),
h AS (SELECT user_id, song, min(back) AS back FROM s WHERE back > 0 GROUP BY ALL), o AS (SELECT user_id, max(back) AS oldest FROM s GROUP BY 1),
p AS (SELECT user_id, song % 40 AS artist, song % 20 AS album FROM s WHERE back = 0)
SELECT c.user_id, c.song, round(6 * least(1, (coalesce(x.w, 0) + coalesce(y.w, 0)) / total) + CASE WHEN c.song % 40 = p.artist THEN 2 ELSE 0 END + CASE WHEN c.song % 20 = p.album THEN 1 ELSE 0 END
  + CASE WHEN h.back IS NOT NULL THEN -20 - (oldest - h.back) WHEN near IS NULL THEN 1 ELSE -6 * pow(0.7, near) - 1.5 * least(4, plays) END, 6) AS score
FROM c JOIN tot USING (user_id) JOIN o USING (user_id) JOIN p USING (user_id) LEFT JOIN gw x ON x.user_id = c.user_id AND x.genre = 'g' || (c.song % 7) LEFT JOIN gw y ON y.user_id = c.user_id AND y.genre = 'g' || (7 + c.song % 3)
  LEFT JOIN ar ON ar.user_id = c.user_id AND ar.artist = c.song % 40 LEFT JOIN h ON h.user_id = c.user_id AND h.song = c.song""")
def additive_scores(t):
    def told(df):
        s = F.col("song")
        text = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
        return df.select(*df.columns, text("a", s % 40).alias("artist"), text("l", s % 20).alias("album"), F.array(text("g", s % 7), text("g", 7 + s % 3)).alias("genres"))

    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    session = t.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("song"), back.alias("back"))
    candidates = session.filter("back < 20").select("user_id", ((F.col("song") + 1) % 100).alias("song")).distinct()
    scored = mx.additive_scores(told(session), told(candidates), "user_id", "back", "song", "artist", "album", "genres")
    return scored.select("user_id", "song", F.round("score", 6).alias("score"))


@query("""
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - greatest(10, count(*) OVER () // 4) AS tested FROM events""")
def temporal_holdout(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return mx.temporal_holdout(t.events.select("event_id", at.alias("micros")), F.col("micros"), ["micros", "event_id"]).select("event_id", "tested")


@query("""
WITH h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('artist:' || lower(c_name), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h FROM customer)
SELECT c_custkey, CAST(h % 4096 AS INTEGER) AS index, CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END AS sign FROM h""")
def hashed_feature(t):
    return t.customer.select("c_custkey", mx.hashed_feature(F.concat(F.lit("artist:"), F.lower("c_name"))).alias("f")).select("c_custkey", "f.index", "f.sign")


@query(f"""
WITH e AS (SELECT user_id, {K} % 10 AS item, event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS kind FROM events),
n AS (SELECT *, coalesce(lead(event_id) OVER w, 1000000000) AS ends, lead(kind) OVER w AS how FROM e WINDOW w AS (PARTITION BY user_id, item ORDER BY event_id)),
p AS (SELECT * FROM n WHERE kind = 0),
crowds AS (
  SELECT a.event_id, s.event_id AS at, count(*) AS waiting FROM p a JOIN p s ON s.user_id = a.user_id AND s.event_id > a.event_id AND s.event_id < a.ends
  JOIN p q ON q.user_id = a.user_id AND q.event_id > a.event_id AND q.event_id <= s.event_id AND q.ends > s.event_id GROUP BY ALL)
SELECT user_id, item, event_id AS picked_at, ends AS label_at, ends % 2 AS reward FROM p WHERE how = 1 AND event_id NOT IN (SELECT event_id FROM crowds WHERE waiting >= 4)""")
def first_feedback(t):
    e = t.events.select("user_id", (F.get_json_object("props", "$.k").cast("int") % 10).alias("item"), F.col("event_id").alias("at"), F.col("event_type").isin("purchase", "error").alias("said"))
    picks, said = e.filter("NOT said").drop("said"), e.filter("said").select("user_id", "item", "at", (F.col("at") % 2).alias("reward"))
    return mx.first_feedback(picks, said, "user_id", "item", "at", 4)


@query(f"""
WITH p AS (SELECT user_id AS instance, {K} AS duration, CAST(round(value) AS BIGINT) AS seconds, event_id FROM events WHERE event_type <> 'error')
SELECT instance, duration, CAST(sum(seconds) AS BIGINT) AS heard, min(event_id) AS started FROM p WHERE duration > 30 GROUP BY ALL HAVING sum(seconds) >= least(duration / 2.0, 240)""")
def scrobbles(t):
    plays = t.events.select(F.col("user_id").alias("instance"), F.lit("t").alias("title"), F.when(F.col("event_type") == "error", " ").otherwise("a").alias("artist"), F.get_json_object("props", "$.k").cast("int").alias("duration"), F.round("value").cast("long").alias("seconds"), "event_id")
    return mx.scrobbles(plays, "instance", "title", "artist", "seconds", "duration", "event_id").select("instance", "duration", "heard", "started")


@query("SELECT o_custkey, count(*) AS members, count(*) FILTER (o_orderstatus = 'F') AS good FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') = 0")
def settled_groups(t):
    return mx.settled_groups(t.orders, "o_custkey", F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")


@query()
def champion_weights(t):
    """Each listener's decision, with its AUCs: what was bought or looked at is kept, by value and k."""
    kept = F.col("event_type").isin("purchase", "view")
    rows = t.events.select((F.col("user_id") % 40).alias("who"), "event_id", (F.col("value") / 100).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("y"), kept.alias("kept"), F.lit(1.0).alias("w"))
    return mx.champions(rows, "who", "event_id", "event_id", ["x", "y"], F.col("kept"), "w")[0]
