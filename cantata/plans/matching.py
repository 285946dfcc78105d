"""Loose matches, families, places, lyrics, signals, providers, mixes and vectors over the driver's tables, each beside its SQL."""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.functions import matching as m
from cantata.functions import places
from cantata.operators import learning, mixes, signals
from cantata.operators.ordering import page
from cantata.plans.common import Registry

registry = Registry()
query = registry.query


def _pick(key: str, *forms):
    """The form whose number is the key's remainder."""
    return F.get(F.array(*[f if not isinstance(f, str) else F.lit(f) for f in forms]), (F.col(key) % len(forms)).cast("int"))


def _after(c: str, *endings: str):
    return [F.concat(c, F.lit(e)) for e in endings]


# names with notes, for DuckDB to work the rule out
_NOTED = "upper(p_name || CASE p_partkey % 8 WHEN 0 THEN ' (Deluxe Edition) 2' WHEN 1 THEN ' - Remastered 2009' WHEN 2 THEN ' feat. X' WHEN 3 THEN '!  ' WHEN 4 THEN ' [Explicit] (Live)' WHEN 5 THEN ' (Live)' WHEN 6 THEN '(deluxe)x' ELSE ' ft. Y (clean)' END)"
_NOTES = "|".join(re.escape(n).replace("\\ ", " ") for n in m.NAME_NOTES)


@query(rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_NOTED}), '(?s)({_NOTES}).*$', ''), '\s', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS plain FROM part")
def plain_names(t):
    return t.part.select("p_partkey", m.plain_ascii(F.expr(_NOTED)).alias("plain"))


@query("SELECT p_partkey, p_partkey % 4 <> 2 AS alike FROM part")
def artists_match(t):
    words = F.split("p_name", " ")
    found = _pick("p_partkey", F.upper("p_brand"), F.concat_ws(" ", words[1], words[0]), "zzz qqq", "Любэ")
    return t.part.select("p_partkey", m.artists_match(F.concat("p_brand", F.lit(" feat. "), "p_name"), found).alias("alike"))


@query("SELECT p_partkey, p_partkey % 5 <> 1 AS alike, p_partkey % 5 IN (0, 3) AS same_recording FROM part")
def titles_match(t):
    asked = F.concat("p_name", F.lit(" [Deluxe]"))
    found = _pick("p_partkey", F.concat("p_name", F.lit(" - Remastered")), "zzz qqq", F.concat("p_name", F.lit(" (demo)")), "", F.concat("p_name", F.lit(" remix")))
    return t.part.select("p_partkey", m.titles_match(asked, found).alias("alike"), m.track_titles_match(asked, found).alias("same_recording"))


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' (x)  y' WHEN 1 THEN '[a] ' || p_name || ')' WHEN 2 THEN p_name || ' (b [c) d] (e' ELSE p_name || '  (f)(g) [h]i' END"
_LINE = "CASE p_partkey % 5 WHEN 0 THEN p_brand || ' feat. Z; Q' WHEN 1 THEN p_brand || ' x Y ft Z' WHEN 2 THEN p_brand || ' and W' WHEN 3 THEN ' ' || p_brand || ' & V, U' ELSE ', ' || p_brand END"


@query(rf"""
SELECT p_partkey, 'name:' || trim(regexp_replace(regexp_replace(lower({_TITLE}), '\s*[(\[].*?[)\]]', '', 'g'), '\s+', ' ', 'g')) || '|' ||
       lower(trim(regexp_extract({_LINE}, '^(.*?)(?:,|;|&| feat\.? | ft\.? | x |$)', 1))) AS key FROM part""")
def suggestion_keys(t):
    return t.part.select("p_partkey", m.suggestion_key(F.expr(_TITLE), F.expr(_LINE)).alias("key"))


FAMILIES = {"rock": ["rock", "hard rock", "punk"], "pop": ["pop", "synth pop", "pop rock"], "rnb": ["rnb", "soul"], "small": ["small"]}


@query("""
SELECT p_partkey, p_partkey % 6 AS form, unnest(CASE p_partkey % 6 WHEN 0 THEN ['rock', 'pop'] WHEN 1 THEN ['pop'] WHEN 2 THEN ['rnb'] WHEN 3 THEN ['rock']
  WHEN 4 THEN ['rock', 'tag:poprock'] ELSE [CASE WHEN p_type = 'SMALL' THEN 'small' ELSE 'tag:' || lower(p_type) END] END) AS family FROM part""")
def genre_families(t):
    tag = _pick("p_partkey", "Hard Rock; Pop|ROCK", "Pop-Rock", "R & B, 1999, Music", "Pop Rock Punk", "Punk/poprock", F.col("p_type"))
    return t.part.select("p_partkey", (F.col("p_partkey") % 6).alias("form"), F.explode(m.genre_families(tag, FAMILIES)).alias("family"))


@query(r"""
WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN '/' WHEN 1 THEN 'C:' WHEN 2 THEN '//' WHEN 3 THEN 'network://nas' WHEN 4 THEN 'volume:Card' ELSE '/' END AS root,
  CASE k WHEN 0 THEN '/' WHEN 1 THEN 'C:\' WHEN 2 THEN '\\' WHEN 3 THEN 'Home' WHEN 4 THEN 'Card' ELSE '/' END AS label,
  CASE k WHEN 2 THEN 'host/share/' || s WHEN 5 THEN 'a b/' || s ELSE s END AS folders, CASE WHEN k = 0 THEN 'x.cue' ELSE 'x.flac' END AS file FROM c""")
def file_locations(t):
    s = F.col("c_mktsegment")
    of = lambda before, after: F.concat(F.lit(before), s, F.lit(after))
    path = _pick("c_custkey", of("/", "/x.cue#track07"), of("c:\\", "\\x.flac"), of("\\\\host\\share\\", "\\x.flac"), of("network://NAS/", "//x.flac"), of("Card/", "/x.flac"), of("file:///a%20b/", "/x.flac"))
    found = t.customer.select("c_custkey", places.file_location(path, {"nas": "Home"}).alias("at"))
    return found.select("c_custkey", "at.root", "at.label", F.array_join("at.folders", "/").alias("folders"), "at.file")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 18 HOUR WHEN 2 THEN o_orderdate + INTERVAL 21 HOUR END AS at,
  CASE o_orderkey % 4 WHEN 0 THEN false WHEN 3 THEN NULL ELSE true END AS has_time FROM orders""")
def event_times(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamped = lambda end: F.concat(day, F.lit(end))
    start = _pick("o_orderkey", day, stamped("T18:00"), stamped("T10:00:00-02:00"), "2023-02-29T20:00")
    at = places.event_time(start, F.when(F.col("o_orderkey") % 4 == 1, "Nowhere/Land").otherwise("Asia/Tokyo"))
    return t.orders.select("o_orderkey", at.alias("e")).select("o_orderkey", "e.at", "e.has_time")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Hello ' || event_type || chr(10) || 'oh' WHEN 1 THEN '' ELSE '' END AS lyrics, event_id % 3 <> 1 AS has_lyrics FROM events""")
def plain_lyrics(t):
    sung = F.concat(F.lit("[ar:Someone]\n[00:01.20][00:40] v1: Hello  <00:01.9>"), "event_type", F.lit("\n[bg: oh ]\n\n[00:09.00]"))
    lyrics = _pick("event_id", sung, "[ti:x]\n[00:01.0]\n", " [Instrumental:True] ")
    shown = F.when(m.is_instrumental(lyrics), "").otherwise(m.plain_lyrics(lyrics))
    return t.events.select("event_id", shown.alias("lyrics"), m.has_lyrics(lyrics).alias("has_lyrics"))


@query("""
WITH e AS (SELECT user_id, event_id, nullif(event_type, 'view') AS text FROM events), f AS (SELECT user_id, text, min(event_id) AS first FROM e WHERE text IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS INTEGER) AS segment FROM f), d AS (SELECT user_id, sha256(string_agg(text, chr(10) ORDER BY first)) AS sha256 FROM f GROUP BY 1)
SELECT e.user_id, event_id, segment, sha256 FROM e LEFT JOIN n ON n.user_id = e.user_id AND n.text = e.text LEFT JOIN d ON d.user_id = e.user_id""")
def line_segments(t):
    lines = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "view", F.concat(F.lit(" "), "event_type")).alias("text"))
    return signals.line_segments(lines, "user_id", "event_id", "text").join(signals.texts_digest(lines, "user_id", "event_id", "text"), "user_id", "left")


@query("""
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'id' || o_custkey ELSE strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || o_orderstatus END AS key FROM orders)
SELECT key, min(o_orderkey) AS o_orderkey FROM e GROUP BY 1""")
def distinct_events(t):
    key = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" id"), F.col("o_custkey").cast("string")))
    events = t.orders.select("o_orderkey", key.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.col("o_orderpriority").alias("place"), F.col("o_orderstatus").alias("venue"))
    return signals.distinct_events(events, "id", "start", "place", "venue", "o_orderkey").select("key", "o_orderkey")


@query("SELECT user_id, count(*) AS outcomes FROM events GROUP BY 1 HAVING count(*) - CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END >= 10")
def training_due(t):
    trained = t.events.select("user_id").distinct().filter("user_id % 2 = 0").select("user_id", F.col("user_id").alias("n"))
    return learning.training_due(t.events, "user_id", trained, 10)


@query()
def preferences(t):
    """Each user's events as outcomes: what the type of an event by its hour tells of a purchase to come."""
    known = {"title": F.col("event_type"), "artist": F.get_json_object("props", "$.k"), "album": F.lit(None).cast("string"), "genre": F.col("event_type"), "seconds": F.col("value")}
    before = {"artist": F.lit("x"), "genre": F.lit("view")}
    features = learning.preference_features(known, before, F.hour("ts"))
    learnt = learning.learn_preferences(t.events, "user_id", "ts", "event_id", features, (F.col("value") > 50).cast("int"), F.lit(1.0))
    return learnt.withColumn("points", learning.preference_points(F.col("preference"), F.col("observations")))


class _Balance:
    """The balance, in thousands."""

    def prepare(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("thousands", F.col("c_acctbal") / 1000)

    def score(self):
        return F.col("thousands")


class _Orders:
    """How many orders there are; unknown where there are none."""

    def __init__(self, orders: DataFrame):
        self.counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))

    def prepare(self, candidates: DataFrame) -> DataFrame:
        return candidates.join(self.counts, "c_custkey", "left")

    def score(self):
        return F.col("n")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, round(c_acctbal / 1000, 6) AS balance, CAST(coalesce(n, 0) AS DOUBLE) AS orders, round(c_acctbal / 1000 * 0.5 + coalesce(n, 0) * 2, 6) AS score FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def with_signals(t):
    scored = signals.with_signals(t.customer.select("c_custkey", "c_acctbal"), {"balance": (_Balance(), 0.5), "orders": (_Orders(t.orders), 2.0)})
    return scored.select("c_custkey", F.round("balance", 6).alias("balance"), "orders", F.round("score", 6).alias("score"))


@query("""
WITH a AS (
  SELECT n_nationkey, s_suppkey % 40 AS id, min(s_suppkey) AS added, 0 AS part FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2 UNION ALL
  SELECT n_nationkey, c_custkey % 40, min(c_custkey), 1 FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY n_nationkey, id ORDER BY part) = 1)
SELECT n_nationkey, id, added, part, row_number() OVER (PARTITION BY n_nationkey ORDER BY part, added, id) AS place FROM f QUALIFY place <= 12""")
def ask_providers(t):
    def provider(rows, key, nation):
        return lambda asked: asked.join(rows.select(F.col(nation).alias("n_nationkey"), (F.col(key) % 40).alias("id"), F.col(key).alias("added")), "n_nationkey")

    parts = [provider(t.supplier, "s_suppkey", "s_nationkey"), provider(t.customer, "c_custkey", "c_nationkey")]
    return signals.ask_providers(t.nation.select("n_nationkey"), "n_nationkey", parts, ["id"], "added", 12)


@query("""
WITH x AS (SELECT c_nationkey, c_custkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'favorites' WHEN c_custkey % 7 < 3 THEN 'fresh' ELSE 'genre' END AS kind FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, kind ORDER BY c_acctbal DESC, c_custkey) AS rn FROM x)
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN kind = 'favorites' THEN 0 WHEN kind = 'fresh' THEN 2 WHEN rn <= 2 THEN 1 ELSE 3 END, CASE WHEN kind = 'genre' THEN rn ELSE 0 END, c_custkey) AS position FROM r""")
def order_mixes(t):
    kind = F.when(F.col("c_custkey") % 7 == 0, "favorites").when(F.col("c_custkey") % 7 < 3, "fresh").otherwise("genre")
    return signals.order_mixes(t.customer.withColumn("kind", kind), "c_nationkey", "kind", "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "position")


ORDERED = {"title": "p_name", "artist": "p_brand", "album": "p_type", "disc": "disc", "track": "p_partkey", "added": "p_size", "album_artist": "p_brand", "depth": "disc", "rate": "p_size", "bitrate": "p_retailprice"}


def _library_sql(mode: str) -> str:
    zero = signals.ABSENT_IS_ZERO.get(mode, ())
    terms = [f"{f'coalesce({ORDERED[f]}, 0)' if f in zero else ORDERED[f]} {'DESC NULLS LAST' if f in signals.FALLING else 'ASC NULLS FIRST'}" for f in signals.LIBRARY_ORDERS[mode]]
    return f"SELECT '{mode}' AS mode, p_partkey, row_number() OVER (ORDER BY {', '.join(terms)}, p_partkey) AS position FROM p QUALIFY position <= 30"


@query("WITH p AS (SELECT *, nullif(p_partkey % 3, 0) AS disc FROM part) " + " UNION ALL ".join(map(_library_sql, signals.LIBRARY_ORDERS)))
def library_orders(t):
    parts = t.part.withColumn("disc", F.nullif(F.col("p_partkey") % 3, F.lit(0)))
    pages = [page(parts, [*signals.library_terms(mode, ORDERED), F.col("p_partkey").asc()], 30).select(F.lit(mode).alias("mode"), "p_partkey", "position") for mode in signals.LIBRARY_ORDERS]
    return reduce(DataFrame.unionByName, pages)


@query("SELECT vec_id, label AS size FROM embeddings WHERE vec_id % 4 <> 1 AND (vec_id % 4 = 0 OR vec_id % 3 = 0) AND label >= 2")
def vector_store(t):
    """Every fourth vector is analysed anew, every fourth in vain; the rest are of version 1 but for those by three."""
    row = lambda version, vector: ["vec_id", version.alias("version"), vector.alias("vector"), "label"]
    old = t.embeddings.select(*row(F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1), F.col("embedding")))
    new = t.embeddings.filter("vec_id % 4 < 2").select(*row(F.lit(2), F.when(F.col("vec_id") % 4 == 0, F.col("embedding"))))
    found = signals.get_vectors(signals.put_vectors(old, new, "vec_id"), t.embeddings.filter("label >= 2"), "vec_id", "vector", 2)
    return found.join(t.embeddings.select("vec_id", F.col("label").alias("size")), "vec_id").select("vec_id", "size")


@query()
def library_mixes(t):
    """Orders as songs of eight libraries, customers as artists, priorities and states as genres."""
    k = F.col("o_orderkey")
    genres = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderpriority"))
    columns = [(F.col("o_custkey") % 8).alias("who"), k.alias("song"), (F.col("o_custkey") % 97).cast("string").alias("artist"), genres.alias("families")]
    heard = [F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("added"), (k % 5 * (k % 2)).cast("double").alias("plays"), (k % 7).cast("double").alias("past")]
    return mixes.library_mixes(t.orders.select(*columns, *heard), datetime.date(1998, 1, 1))
