"""Queries over frames (the embeddings stand for spectra, each label for a track, by vec_id), over feeds and kept indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantata.functions import dates
from cantata.operators import feed, landmarks, search_index, spacing, spectra
from cantata.operators.checkpoints import checkpoint_folder
from cantata.plans.common import Registry
from cantata.sources import markup

registry = Registry()
query = registry.query

#: A shape for 64 bins and some fifty frames a track.
SHAPE = landmarks.Shape(bins=(-4, -3, 1, 2), frames=(-5, -2, 1, 4), before=1, back=(1, 3), least=0.25, lowest=5, highest=61)


def frames(t):
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return t.embeddings.select("label", place.alias("pos"), F.transform("embedding", lambda x: 64 * x.cast("double") * x.cast("double")).alias("spectrum"))


_PEAKS = f"""
f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: 64 * CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS s FROM embeddings),
ends AS (SELECT label, max(pos) AS last FROM f GROUP BY 1),
e AS (SELECT label, pos, unnest(s) AS e, generate_subscripts(s, 1) - 1 AS bin, len(s) AS n FROM f),
u AS (SELECT label, pos, bin, CASE WHEN bin < n - 2 THEN max(e) OVER (PARTITION BY label, pos ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) ELSE e END AS u FROM e),
p AS (SELECT label, pos, bin, greatest(u, lead(u, 1) OVER w, lead(u, 3) OVER w) AS p FROM u WINDOW w AS (PARTITION BY label, bin ORDER BY pos)),
peak AS (
  SELECT e.label, e.pos, e.bin, e.e FROM e JOIN ends USING (label) WHERE e >= 0.25 AND bin BETWEEN 5 AND 61 AND pos <= last - 7
    AND NOT EXISTS (SELECT 1 FROM p WHERE p.label = e.label AND p.pos = e.pos - 1 AND ((p.bin = e.bin - 1 AND p.p > e.e) OR (p.bin - e.bin IN (-4, -3, 1, 2) AND p.p >= e.e)))
    AND NOT EXISTS (SELECT 1 FROM p WHERE p.label = e.label AND p.bin = e.bin - 1 AND p.pos - e.pos IN (-5, -2, 1, 4) AND p.p >= e.e)),
loud AS (SELECT label, pos, bin, ln(greatest(e, 0.25)) * 1477.3 + 6144 AS m FROM e),
peaks AS (
  SELECT k.label, k.pos, k.bin, CAST(trunc(k.bin * 64 + (a.m - b.m) * 32 / (2 * m.m - b.m - a.m)) AS INTEGER) AS place, CAST(trunc(m.m) AS INTEGER) AS magnitude
  FROM peak k JOIN loud b ON b.label = k.label AND b.pos = k.pos AND b.bin = k.bin - 1 JOIN loud m ON m.label = k.label AND m.pos = k.pos AND m.bin = k.bin
  JOIN loud a ON a.label = k.label AND a.pos = k.pos AND a.bin = k.bin + 1 WHERE 2 * m.m - b.m - a.m > 0)"""

_PAIRS = """
numbered AS (SELECT label, pos, bin, row_number() OVER (PARTITION BY label ORDER BY pos, bin) AS nth FROM {peaks}),
{name} AS (
  SELECT a.label, a.pos, (a.bin << 42) + (b.bin << 21) + b.pos - a.pos AS hash FROM numbered a JOIN numbered b ON b.label = a.label AND b.nth - a.nth BETWEEN 1 AND 5 AND b.pos - a.pos <= 8)"""


@query(f"WITH {_PEAKS} SELECT label, pos, CAST(bin AS INTEGER) AS bin, place, magnitude FROM peaks")
def landmark_peaks(t):
    return landmarks.peaks(frames(t), "label", "pos", "spectrum", SHAPE)


@query(f"WITH {_PEAKS}, {_PAIRS.format(peaks='peaks', name='pairs')} SELECT * FROM pairs")
def landmark_pairs(t):
    return landmarks.pairs(landmark_peaks(t), "label", "pos", "bin", ahead=8)


# what is asked for: of every label the peaks from its fifth frame on, a fifth of them lost
@query(f"""
WITH {_PEAKS}, {_PAIRS.format(peaks='peaks', name='pairs')},
thin AS (SELECT label, pos - 5 AS pos, bin FROM peaks WHERE pos >= 5 AND (pos * 7 + bin) % 5 <> 0),
{_PAIRS.format(peaks='thin', name='asked').replace('numbered', 'renumbered')}
SELECT a.label AS q, p.label, p.pos - a.pos AS "offset", count(*) AS votes FROM asked a JOIN pairs p USING (hash) GROUP BY ALL""")
def landmark_votes(t):
    found = landmarks.checkpointed(landmark_peaks(t))
    thin = found.filter("pos >= 5 AND (pos * 7 + bin) % 5 <> 0").select(F.col("label").alias("q"), (F.col("pos") - 5).alias("pos"), "bin")
    return landmarks.votes(landmarks.pairs(thin, "q", "pos", "bin", ahead=8), landmarks.pairs(found, "label", "pos", "bin", ahead=8), "q", "label", "pos")


# an event of a user at a time is a frame; its value is how strong it is
_FRAMES = "f AS (SELECT user_id % 40 AS who, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) - 1 AS pos, value / 100 AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS loud FROM events)"


def event_frames(t):
    place = F.row_number().over(Window.partitionBy("who").orderBy("ts", "event_id")) - 1
    loud = F.get_json_object("props", "$.k").cast("double") / 100
    return t.events.withColumn("who", F.col("user_id") % 40).select("who", place.cast("long").alias("pos"), (F.col("value") / 100).alias("value"), loud.alias("loud"))


_ONSETS = f"""
{_FRAMES},
o AS (SELECT * FROM (SELECT *, max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, avg(value) OVER (w ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS mean FROM f WINDOW w AS (PARTITION BY who ORDER BY pos))
  WHERE value >= 0.002 AND value >= top AND value >= 1.5 * mean)"""


@query(f"WITH RECURSIVE {_ONSETS}, k AS (SELECT who, min(pos) AS pos FROM o GROUP BY 1 UNION ALL SELECT k.who, (SELECT min(o.pos) FROM o WHERE o.who = k.who AND o.pos >= k.pos + 4) AS pos FROM k WHERE k.pos IS NOT NULL) SELECT who, pos FROM k WHERE pos IS NOT NULL")
def spaced_onsets(t):
    return spacing.spaced(spacing.onset_peaks(event_frames(t), "who", "pos", "value").select("who", "pos"), "who", "pos")


# every row is a candidate: long chains, nine places apart
@query(f"WITH RECURSIVE {_FRAMES}, o AS (SELECT who, pos FROM f WHERE value > 0.3), k AS (SELECT who, min(pos) AS pos FROM o GROUP BY 1 UNION ALL SELECT k.who, (SELECT min(o.pos) FROM o WHERE o.who = k.who AND o.pos >= k.pos + 9) AS pos FROM k WHERE k.pos IS NOT NULL) SELECT who, pos FROM k WHERE pos IS NOT NULL")
def spaced_rows(t):
    return spacing.spaced(event_frames(t).filter("value > 0.3").select("who", "pos"), "who", "pos", 9)


@query(f"""
WITH {_FRAMES},
g AS (SELECT who, greatest(0.002, list_sort(list(loud))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] * 0.1) AS gate FROM f GROUP BY 1),
m AS (SELECT *, max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, greatest(0.15, 2.4 * avg(value) OVER (w ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING)) AS threshold FROM f WINDOW w AS (PARTITION BY who ORDER BY pos))
SELECT who, pos, CAST(round(threshold * 1000) AS BIGINT) AS thousandths FROM m JOIN g USING (who) WHERE loud >= gate AND value > threshold * 0.7 AND value >= top AND pos >= 2""")
def loud_hits(t):
    found = spacing.hits(event_frames(t), "who", "pos", "value", "loud", 0.7)
    return found.select("who", "pos", F.round(F.col("threshold") * 1000).cast("long").alias("thousandths"))


# items are a user's values of k; an error removes one; three cursors: of nothing, from before the horizon (3000), and after it
_FEED = "c AS (SELECT user_id || ':' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS item, event_id AS seq, event_type = 'error' AS gone, CAST(round(value) AS BIGINT) AS amount FROM events)"
_CURSORS = (0, 100, 3500)


@query(f"""
WITH {_FEED}, last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY seq DESC) = 1),
""" + ", ".join(f"d{i} AS (SELECT {since} AS since, item, seq, gone AS removed, amount, {since < 3000} AS reset FROM last WHERE {'NOT gone' if since < 3000 else f'seq > {since}'} AND (SELECT max(seq) FROM c) > {since})" for i, since in enumerate(_CURSORS)) + " UNION ALL ".join(f" SELECT * FROM d{i}" for i in range(len(_CURSORS))))
def feed_deltas(t):
    item = F.concat_ws(":", "user_id", F.get_json_object("props", "$.k").cast("int") % 20)
    rows = t.events.select(item.alias("item"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("gone"), F.round("value").cast("long").alias("amount"))
    early = feed.compacted(rows.filter("seq < 2000"), "item", "seq", F.col("gone"), 1000)  # compacted once before, with a horizon of its own
    whole = feed.compacted(early.drop("removed").unionByName(rows.filter("seq >= 2000")), "item", "seq", F.col("gone"), 3000)
    told = [feed.delta(whole, "seq", since, 3000).select(F.lit(since).alias("since"), "item", "seq", "removed", "amount", "reset") for since in _CURSORS]
    return told[0].unionByName(told[1]).unionByName(told[2])


# of the documents every tenth has been changed since the index was written, every eleventh is gone
@query("""
WITH now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'zebra ' || reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 1)
SELECT 'ing the' AS phrase, doc_id FROM now WHERE contains(lower(text), 'ing the') UNION ALL SELECT 'zebra e', doc_id FROM now WHERE contains(lower(text), 'zebra e')
UNION ALL SELECT 'on', doc_id FROM now WHERE contains(lower(text), 'on')""")
def kept_index(t):
    docs = t.documents.select("doc_id", "text")
    path = f"{checkpoint_folder(t.spark)}/index-{uuid.uuid4().hex}"
    search_index.write_index(docs, "doc_id", F.col("text"), path)
    changed = F.concat(F.lit("zebra "), F.reverse("text"))
    now = docs.filter("doc_id % 11 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 0, changed).otherwise(F.col("text")))
    search_index.add_delta(now.filter("doc_id % 10 = 0"), "doc_id", F.col("text"), docs.filter("doc_id % 11 = 1"), path, 1)
    found = [search_index.search(now, "doc_id", F.col("text"), path, p).select(F.lit(p.lower()).alias("phrase"), "doc_id") for p in ("Ing the", "zebra e", "on")]
    return found[0].unionByName(found[1]).unionByName(found[2])


# a date as tags write it, in eight ways
@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN '' ELSE strftime(CASE WHEN o_orderkey % 8 IN (0, 1, 4) THEN o_orderdate WHEN o_orderkey % 8 = 2 THEN date_trunc('month', o_orderdate) ELSE date_trunc('year', o_orderdate) END, '%d/%m %y, %Y (%b, %B) 100%%') || ' %q' END AS shown
FROM orders""")
def tag_dates(t):
    k, day = F.col("o_orderkey") % 8, lambda f: F.date_format("o_orderdate", f)
    tag = (
        F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, F.concat(F.lit(" "), day("yyyy/MM/dd"))).when(k == 2, day("yyyy.MM")).when(k == 3, day("yyyy")).when(k == 4, F.concat(day("yyyy-MM-dd"), F.lit("T23:59:59.5-07:00")))
        .when(k == 5, F.concat(F.lit("released "), day("yyyy"), F.lit(", 2001"))).when(k == 6, F.concat(day("yyyy-MM"), F.lit("/31"))).otherwise("unknown")
    )
    return t.orders.select("o_orderkey", dates.date_text(tag, "%d/%m %y, %Y (%b, %B) 100%% %q").alias("shown"))


@query("""
SELECT p_partkey, 0 AS line, p_size * 1000 + 500 AS time_ms, (p_size + 2) * 1000 AS end_ms, 'v1' AS voice, p_name AS line_text, 2 AS words FROM part
UNION ALL SELECT p_partkey, 1, (p_size + 60) * 1000, (p_size + 60) * 1000 + 250, 'v2', p_brand, 0 FROM part
UNION ALL SELECT p_partkey, 2, 3600000, 3602000, 'v1', lower(p_type), 2 FROM part""")
def timed_lines(t):
    word = F.split("p_name", " ")
    span = lambda begin, end, text, more="": F.concat(F.lit("<span "), F.lit(more), F.lit('begin="'), begin, F.lit('" end="'), end, F.lit('">'), text, F.lit("</span>"))
    s, two = F.col("p_size").cast("string"), (F.col("p_size") + 2).cast("string")
    xml = F.concat(
        F.lit('<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><head/><body><div ttm:agent="v1"><p>'),
        span(F.concat(s, F.lit(".5s")), F.concat(s, F.lit(".9")), word[0]), span(F.concat(s, F.lit(".9s")), two, F.concat_ws(" ", F.slice(word, 2, 99))),
        F.lit('</p><p ttm:agent="v2" dur="250ms" begin="00:01:'), F.lpad(s, 2, "0"), F.lit('"> '), F.col("p_brand"), F.lit(" </p><p>"),
        span(F.lit("1h"), F.lit("01:00:01.5"), F.lower("p_type")), F.lit('<span ttm:role="x-bg">'), span(F.lit("60:01"), F.lit("3602s"), F.lit("(ooh)")), F.lit("</span></p></div></body></tt>"),
    )
    return markup.ttml_lines(t.part.select("p_partkey", xml.alias("xml")), "xml").select("p_partkey", "line", "time_ms", "end_ms", "voice", "line_text", F.size("words").alias("words"))


@query("""
SELECT s_suppkey, '/dav/' || s_suppkey || '/' AS href, CAST(s_suppkey AS VARCHAR) AS name, true AS folder, NULL AS size FROM supplier
UNION ALL SELECT s_suppkey, 'https://h/dav/' || s_suppkey || '/' || replace(s_name, '#', '%23') || '%20x.flac', s_name || ' x.flac', false, s_nationkey * 100 FROM supplier""")
def listed_entries(t):
    k, name = F.col("s_suppkey").cast("string"), F.replace("s_name", F.lit("#"), F.lit("%23"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><D:multistatus xmlns:D="DAV:"><D:response><D:href>/dav/'), k, F.lit("/</D:href><D:propstat><D:prop><D:resourcetype><D:collection/></D:resourcetype></D:prop><D:status>HTTP/1.1 200 OK</D:status></D:propstat></D:response>"),
        F.lit("<D:response><D:href>https://h/dav/"), k, F.lit("/"), name, F.lit("%20x.flac</D:href><D:propstat><D:prop><D:getcontentlength>7</D:getcontentlength></D:prop><D:status>HTTP/1.1 404 Not Found</D:status></D:propstat><D:propstat><D:prop><D:getcontentlength>"),
        (F.col("s_nationkey") * 100).cast("string"), F.lit("</D:getcontentlength><D:resourcetype/></D:prop><D:status>HTTP/1.1 200 OK</D:status></D:propstat></D:response></D:multistatus>"),
    )
    return markup.webdav_entries(t.supplier.select("s_suppkey", xml.alias("xml")), "xml").select("s_suppkey", "href", "name", "folder", "size")


@query()
def spectral_tracks(t):
    """Each vector is a frame of 64 samples, each label a track."""
    framed = spectra.frame_features(t.embeddings.select("label", "vec_id", "embedding"), ["label", "vec_id"], "embedding", 8000.0)
    return spectra.track_features(framed, "label")


@query()
def beat_grids(t):
    """Listeners' events as frames, 25 a second: values are onsets, k is how loud it is."""
    return spectra.beat_grids(event_frames(t), "who", "pos", "value", "loud", 25.0)
