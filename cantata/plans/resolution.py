"""Entity resolution and candidate scores over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantata.functions import scores as sc
from cantata.operators import parts
from cantata.operators import resolution as rs
from cantata.plans.common import Registry

registry = Registry()
query = registry.query


@query("""
WITH r AS (SELECT s_suppkey, 'Customer#' || lpad(CAST(s_suppkey * 40 AS VARCHAR), 9, '0') AS path, CAST(round(s_acctbal / 10) AS BIGINT) AS code, s_nationkey FROM supplier),
p AS (SELECT c_name AS k, min(c_custkey) AS id FROM customer GROUP BY 1), b AS (SELECT CAST(round(c_acctbal / 10) AS BIGINT) AS k, min(c_custkey) AS id FROM customer GROUP BY 1),
n AS (SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 30 = 0 GROUP BY 1)
SELECT s_suppkey, coalesce(p.id, b.id, n.id) AS c_custkey, CASE WHEN p.id IS NOT NULL THEN 'path' WHEN b.id IS NOT NULL THEN 'code' WHEN n.id IS NOT NULL THEN 'names' ELSE '' END AS found_by
FROM r LEFT JOIN p ON r.path = p.k LEFT JOIN b ON r.code = b.k LEFT JOIN n ON r.s_nationkey = n.k""")
def resolution_cascade(t):
    code = lambda c: F.round(F.col(c) / 10).cast("long")
    path = F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 40).cast("string"), 9, "0"))
    some = t.customer.filter("c_mktsegment = 'BUILDING' AND c_custkey % 30 = 0")
    stages = [("path", path, t.customer, F.col("c_name"), "c_custkey"), ("code", code("s_acctbal"), t.customer, code("c_acctbal"), "c_custkey"), ("names", F.col("s_nationkey"), some, F.col("c_nationkey"), "c_custkey")]
    return rs.cascade(t.supplier, stages, "c_custkey").select("s_suppkey", "c_custkey", "found_by")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 4")
def physical_matches(t):
    n = F.col("doc_id").cast("string")
    stored = F.get(F.array(F.concat(F.lit("/Music/A b/"), n), F.concat(F.lit("file:///music/a%20b/"), n), F.concat(F.lit("\\music\\a b\\"), n), F.concat(F.lit("/music/A%20B/"), n), F.concat(F.lit("/other/"), n)), (F.col("doc_id") % 5).cast("int"))
    wanted = t.documents.filter("doc_id % 2 = 0").select(F.concat(F.lit("/music/a b/"), n).alias("wanted"))
    return rs.physical_matches(t.documents.select("doc_id", stored.alias("path")), "doc_id", "path", wanted, "wanted")


# An order asks for a title and an artist; the parts on its lines are the candidates, so a request has few.
PAIRS = """
SELECT DISTINCT o_orderkey, p_partkey, 'T' || (o_orderkey % 5) AS a_isrc, 'T' || (p_size % 5) AS b_isrc,
  CASE o_orderkey % 3 WHEN 0 THEN 'Red Ring' WHEN 1 THEN 'Small Widget!' ELSE 'ring' END AS a_title, p_name || CASE WHEN p_size % 7 = 0 THEN ' (live)' ELSE '' END AS b_title,
  'BRAND ' || (o_custkey % 25) AS a_artist, p_brand AS b_artist, 20 + o_orderkey % 10 AS a_duration, CAST(20 + p_size % 30 AS BIGINT) AS b_duration, o_orderkey % 7 AS a_track, CAST(p_partkey % 7 AS BIGINT) AS b_track
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
WORDS = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _asked(t):
    title = F.get(F.array(F.lit("Red Ring"), F.lit("Small Widget!"), F.lit("ring")), (F.col("o_orderkey") % 3).cast("int"))
    return t.orders.select(
        "o_orderkey", F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string")).alias("a_isrc"), title.alias("a_title"),
        F.concat(F.lit("BRAND "), (F.col("o_custkey") % 25).cast("string")).alias("a_artist"), (20 + F.col("o_orderkey") % 10).alias("a_duration"), (F.col("o_orderkey") % 7).alias("a_track"),
    )


def _found(t):
    return t.part.select(
        "p_partkey", F.concat(F.lit("T"), (F.col("p_size") % 5).cast("string")).alias("b_isrc"), F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " (live)").otherwise("")).alias("b_title"),
        F.col("p_brand").alias("b_artist"), (20 + F.col("p_size") % 30).cast("long").alias("b_duration"), (F.col("p_partkey") % 7).cast("long").alias("b_track"),
    )


def _pairs(t, asked=None, found=None):
    lines = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    asked, found = _asked(t) if asked is None else asked, _found(t) if found is None else found
    return lines.join(asked, F.col("l_orderkey") == F.col("o_orderkey")).join(found, F.col("l_partkey") == F.col("p_partkey")).drop("l_orderkey", "l_partkey")


def _sides(**more):
    both = [{f: F.col(f"{s}_{f}") for f in ("isrc", "title", "artist", "duration", "track")} for s in ("a", "b")]
    return [side | more for side in both]


def _best_sql(scored: str, least: int) -> str:
    return f"WITH p AS ({PAIRS}), w AS (SELECT *, {WORDS.format('a_title')} AS at_, {WORDS.format('b_title')} AS bt, {WORDS.format('a_artist')} AS aa, {WORDS.format('b_artist')} AS ba FROM p), s AS (SELECT o_orderkey, p_partkey, {scored} AS score FROM w) SELECT o_orderkey, p_partkey, score FROM s WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, p_partkey) = 1"


EITHER = "contains({0}, {1}) OR contains({1}, {0})"


@query(_best_sql(f"CASE WHEN a_isrc = b_isrc THEN 100 ELSE 0 END + CASE WHEN at_ = bt THEN 30 WHEN {EITHER.format('at_', 'bt')} THEN 15 ELSE 0 END + CASE WHEN aa = ba THEN 20 WHEN {EITHER.format('aa', 'ba')} THEN 10 ELSE 0 END", 20))
def enrichment_match(t):
    return rs.best_scored(_pairs(t), ["o_orderkey"], "p_partkey", sc.enrichment_score(*_sides()), 20)


# the part's name as an album, the brand as its artists; '#' goes and joins nothing, so "brand 3" is in no "brand3"
@query(_best_sql(f"CASE WHEN b_isrc = 'T1' THEN 25 ELSE 0 END + CASE WHEN replace(lower(a_title), '!', '') = regexp_replace(lower(b_title), '[()]', '', 'g') THEN 100 WHEN {EITHER.format("replace(lower(a_title), '!', '')", "regexp_replace(lower(b_title), '[()]', '', 'g')")} THEN 50 ELSE 0 END + CASE WHEN {EITHER.format('lower(a_artist)', "replace(lower(b_artist), '#', '')")} THEN 30 ELSE 0 END", 50))
def share_match(t):
    a, b = ({"name": F.col(f"{s}_title"), "artists": F.col(f"{s}_artist")} for s in ("a", "b"))
    return rs.best_scored(_pairs(t), ["o_orderkey"], "p_partkey", sc.share_score(a, b, F.col("b_isrc") == "T1", album=True), 50)


# a title without its bracketed note
@query(
    _best_sql(f"CASE WHEN at_ = replace(bt, ' live', '') THEN 50 WHEN {EITHER.format('at_', "replace(bt, ' live', '')")} THEN 25 ELSE 0 END + CASE WHEN lower(a_artist) = lower(b_artist) THEN 60 WHEN {EITHER.format('lower(a_artist)', 'lower(b_artist)')} THEN 30 ELSE 0 END + CASE WHEN abs(a_duration - b_duration) <= 10 THEN 20 ELSE 0 END", 60)
)
def lyrics_match(t):
    a, b = _sides()
    asked, found = (parts.spread(df).withColumns({f"{s}_{f}": c for f, c in sc.lyrics_plain(side).items()}) for df, s, side in ((_asked(t), "a", a), (_found(t), "b", b)))
    return rs.best_scored(_pairs(t, asked, found), ["o_orderkey"], "p_partkey", sc.lyrics_score(a, b, plain=True), 60)


TOKENS = "list_distinct(string_split({0}, ' '))"
OVERLAP = "len(list_intersect(" + TOKENS.format("{0}") + ", " + TOKENS.format("{1}") + ")) / greatest(len(" + TOKENS.format("{0}") + "), len(" + TOKENS.format("{1}") + "))"
REPLACEMENT = (
    "CASE WHEN a_isrc = b_isrc THEN 140 ELSE -120 END"
    f" + CASE WHEN at_ = bt THEN 45 WHEN {OVERLAP.format('at_', 'bt')} >= 0.75 THEN 24 ELSE -25 END + CASE WHEN aa = ba THEN 30 WHEN {OVERLAP.format('aa', 'ba')} >= 0.6 THEN 16 ELSE -20 END"
    " + CASE WHEN abs(a_duration - b_duration) <= 2 THEN 20 WHEN abs(a_duration - b_duration) <= 5 THEN 12 WHEN abs(a_duration - b_duration) <= 10 THEN 5 WHEN abs(a_duration - b_duration) > 20 THEN -30 ELSE 0 END"
    " + CASE WHEN a_track = b_track THEN 6 ELSE 0 END - CASE WHEN contains(bt, 'live') THEN 18 ELSE 0 END"
)


@query(f"""
WITH p AS ({PAIRS}), w AS (SELECT *, {WORDS.format('a_title')} AS at_, {WORDS.format('b_title')} AS bt, {WORDS.format('a_artist')} AS aa, {WORDS.format('b_artist')} AS ba FROM p),
s AS (SELECT o_orderkey, p_partkey, {REPLACEMENT} AS score, o_orderkey % 11 = 0 AS exact FROM w),
r AS (SELECT *, row_number() OVER v AS rn, lead(score) OVER v AS next FROM s WINDOW v AS (PARTITION BY o_orderkey ORDER BY score DESC, p_partkey))
SELECT o_orderkey, p_partkey, score FROM r WHERE rn = 1 AND (exact OR (score >= 85 AND NOT (score < 95 AND coalesce(score - next <= 8, false))))""")
def replacement_match(t):
    a, b = _sides(album=F.lit(""), disc=F.lit(None).cast("int"), year=F.lit(None).cast("int"))
    return rs.surest(_pairs(t), ["o_orderkey"], "p_partkey", sc.replacement_score(a, b), F.col("o_orderkey") % 11 == 0)


@query("""
WITH k AS (SELECT lower(p_name) AS title, lower(p_brand) AS artist, min(p_partkey) AS p_partkey FROM part GROUP BY ALL),
a AS (SELECT o_orderkey, 'Red Ring' AS title, 'brand#' || (o_custkey % 25) AS x, 'brand#' || (o_orderkey % 25) AS y FROM orders),
f AS (SELECT o_orderkey, 0 AS i, 1 AS j, 'red ring' AS title, x AS artist FROM a UNION ALL SELECT o_orderkey, 0, 2, 'red ring', y FROM a WHERE x <> y),
v AS (SELECT o_orderkey, i + 1 AS i, j, title, artist FROM f)
SELECT o_orderkey, arg_min(p_partkey, j) AS p_partkey, min(1000 + j) AS attempt FROM v JOIN k USING (title, artist) GROUP BY 1""")
def recognised(t):
    line = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25).cast("string"), F.lit(" feat. Brand#"), (F.col("o_orderkey") % 25).cast("string"))
    asked = t.orders.select("o_orderkey", F.lit("Red Ring (Remix)").alias("title"), line.alias("artist"))
    return rs.recognised(asked, "o_orderkey", "title", "artist", t.part, "p_name", "p_brand", "p_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def work_left(t):
    records = t.labels.select("doc_id", F.col("quality").alias("version"), (F.col("toxic") == 1).alias("failed"))
    return rs.work_left(t.documents.select("doc_id"), "doc_id", records, 1)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 > 0")
def current_cache(t):
    songs = t.documents.select("doc_id", "n_chars")
    cache = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return rs.current_cache(songs, cache, ["doc_id", "n_chars"])


@query("""
SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND p_brand LIKE '%#1%' OR p_name = 'red widget'""")
def album_hints(t):
    names = t.part.select("p_name").distinct()
    rings = names.filter("p_name LIKE '%ring'").select(F.upper("p_name").alias("album"), F.lit(" #1").alias("artist"))
    hints = rings.unionByName(names.filter("p_name = 'red widget'").select(F.col("p_name").alias("album"), F.lit(None).cast("string").alias("artist")))
    return rs.album_hints(t.part, "p_partkey", "p_name", "p_brand", hints, "album", "artist")


@query("""
SELECT 'n ' || (doc_id % 50) AS name, false AS folder, max(doc_id) AS doc_id FROM documents WHERE doc_id % 4 = 0 GROUP BY ALL
UNION ALL SELECT CAST(doc_id AS VARCHAR), true, doc_id FROM documents WHERE doc_id % 4 = 2""")
def direct_children(t):
    n, small = F.col("doc_id").cast("string"), (F.col("doc_id") % 50).cast("string")
    site = F.lit("https://h.example/dav/m")
    forms = [F.concat(site, F.lit("usic/n%20"), small), F.concat(site, F.lit("usic/"), n, F.lit("?x=1")), F.concat(site, F.lit("%75sic/"), n, F.lit("/")), F.concat(site, F.lit("usic/a/"), n)]
    urls = t.documents.select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % 4).cast("int")).alias("url"))
    return rs.direct_children(urls, "url", "https://h.example/dav/music/", "doc_id").select("name", "folder", "doc_id")


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'isrc:US' || doc_id WHEN 1 THEN 'id:p' || doc_id WHEN 2 THEN 'web:' || doc_id ELSE coalesce(lang, '') || '|' || source END AS key FROM documents""")
def catalogue_keys(t):
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    key = sc.catalogue_key(F.when(kind == 0, F.concat(F.lit(" us"), n)), F.when(kind == 1, F.concat(F.lit("p"), n)), F.when(kind == 2, "web"), n, F.col("lang"), F.col("source"))
    return t.documents.select("doc_id", key.alias("key"))
