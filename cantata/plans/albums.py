"""Album and artist aggregates over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantata.functions import text as fn
from cantata.operators import albums as al
from cantata.plans.common import Registry

registry = Registry()
query = registry.query

MILLI = lambda c: F.round(F.col(c) * 1000).cast("long")
EVENTS = "SELECT *, CAST(round(value * 1000) AS BIGINT) AS milli FROM events"


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE contains(lower(p_name), 'ring') GROUP BY ALL")
def search_groups(t):
    return al.search_groups(t.part, ["p_brand", "p_type"], F.contains(F.lower("p_name"), F.lit("ring")))


KINDS = ["p_name", "p_type", "p_size"]
SUMMARY = " UNION ALL ".join(f"SELECT p_brand, '{k}' AS kind, CAST({k} AS VARCHAR) AS value, count(*) AS uses FROM part GROUP BY ALL" for k in KINDS)


@query(SUMMARY)
def lookup_summary(t):
    return al.lookup_summary(t.part, "p_brand", KINDS)


@query(f"SELECT DISTINCT kind, value FROM ({SUMMARY}) WHERE p_brand IN ('Brand#2', 'Brand#3')")
def active_values(t):
    active = t.part.filter(F.col("p_brand").isin("Brand#2", "Brand#3")).select("p_brand").distinct()
    return al.active_values(al.lookup_summary(t.part, "p_brand", KINDS), "p_brand", active)


@query("""
SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000
GROUP BY c_custkey, c_acctbal HAVING count(o_orderkey) > 0 OR c_acctbal > 5000""")
def counts_having(t):
    some = t.orders.filter("o_orderstatus = 'P' AND o_totalprice > 300000")
    return al.counts_having(t.customer, "c_custkey", some, "o_custkey", F.col("c_acctbal") > 5000).select("c_custkey", "n")


NAMED = "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 0 THEN '  ' ELSE ' ' || p_name END AS album, p_brand AS artist, p_size, p_partkey FROM part"


@query(f"""
SELECT trim(arg_max(album, (p_size, -p_partkey))) AS album, arg_max(artist, (p_size, -p_partkey)) AS artist, CAST(sum(p_size) AS BIGINT) AS amount, count(*) AS n
FROM ({NAMED}) WHERE trim(album) <> '' GROUP BY lower(trim(album)), lower(artist)""")
def totals_by_name(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    return al.totals_by_name(t.part.select(name.alias("album"), F.col("p_brand").alias("artist"), "p_size", "p_partkey"), ["album", "artist"], "p_size", "p_partkey")


@query("""
SELECT c_custkey, count(o_orderkey) AS n, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS preview
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def list_summary(t):
    return al.list_summary(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority")


@query("""
SELECT source, '/m/' || lang || '/' || (doc_id % 7) AS folder, count(*) AS files, min(doc_id || '.txt') AS first_name, max(doc_id || '.txt') AS last_name
FROM documents WHERE lang IS NOT NULL GROUP BY ALL""")
def by_folder(t):
    path = F.concat(F.lit("/m/"), "lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return al.by_folder(t.documents.filter("lang IS NOT NULL").select("source", path.alias("path")), "source", "path")


@query("""
WITH g AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS votes, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS tag FROM events),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, lower(tag) ORDER BY event_id) = 1)
SELECT user_id, arg_max(tag, (votes, -event_id)) AS tag FROM o GROUP BY 1""")
def leading_tag(t):
    tag = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    tags = t.events.select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("votes"), tag.alias("name"))
    return al.leading_tag(tags, "user_id", "name", "votes", "event_id")


@query("""
WITH g AS (SELECT event_id, user_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS kind FROM events),
n AS (SELECT user_id, kind, count(*) AS n FROM g WHERE kind IS NOT NULL GROUP BY ALL),
m AS (SELECT user_id, arg_min(kind, (-n, kind)) AS kind FROM n GROUP BY 1)
SELECT event_id, coalesce(g.kind, m.kind) AS kind FROM g LEFT JOIN m USING (user_id)""")
def fill_by_majority(t):
    some = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("kind"))
    return al.fill_by_majority(some, "user_id", "kind").select("event_id", "kind")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, lower(unnest([o_orderpriority, o_orderstatus, 'N' || (o_orderkey % 2)])) AS credit FROM orders),
n AS (SELECT o_custkey, count(*) AS tracks FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT o_custkey, credit FROM c JOIN n USING (o_custkey) GROUP BY o_custkey, credit, tracks HAVING count(DISTINCT o_orderkey) = tracks""")
def shared_credits(t):
    line = F.concat("o_orderpriority", F.lit(" feat. "), "o_orderstatus", F.lit(" & N"), (F.col("o_orderkey") % 2).cast("string"))
    return al.shared_credits(t.orders, "o_custkey", "o_orderkey", fn.credits(line))


@query("""
SELECT CASE WHEN count(*) = 1 THEN 'single' ELSE 'album' END AS kind, CASE WHEN count(*) = 1 THEN CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) ELSE o_custkey || '|' || o_orderpriority END AS id,
  max(o_orderdate) AS last_at, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority""")
def recent_groups(t):
    return al.recent_groups(t.orders, F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), "o_orderkey", "o_orderdate")


@query("""
SELECT o_custkey, count(*) AS tracks, max(o_orderdate) AS newest, arg_min(nullif(o_orderstatus, 'P'), (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS cover
FROM orders GROUP BY 1 HAVING count(*) > 1""")
def album_groups(t):
    rows = t.orders.withColumn("cover", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")))
    return al.album_groups(rows, "o_custkey", "o_orderdate", "cover", ["o_orderdate", "o_orderkey"])


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value, 1) END AS loudness FROM events")
def last_metric(t):
    said = F.concat(F.lit("I: -70.0 LUFS\nI:  "), F.format_string("%.2f", F.col("value")), F.lit(" LUFS, LRA: 3"))
    log = F.when(F.col("event_type") == "error", "nothing").otherwise(said)
    return t.events.select("event_id", F.round(al.last_metric(log, "I"), 1).alias("loudness"))


LINES = "SELECT user_id, event_id, epoch_us(ts) // 1000 - 1704067200000 AS at_ms, CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 - 1704067200000 + CAST(round(value * 60000) AS BIGINT) - 300000 END AS end_ms, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS line FROM events"


@query(f"""
WITH l AS ({LINES}),
g AS (SELECT *, trim(line) <> '' AS sung, CAST(sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS BIGINT) - CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END AS grp FROM l),
b AS (SELECT user_id, grp, min(at_ms) FILTER (NOT sung) AS blank FROM g GROUP BY ALL),
v AS (SELECT g.*, blank, CASE WHEN end_ms >= at_ms THEN end_ms END AS ok FROM g JOIN b USING (user_id, grp) WHERE sung),
s AS (SELECT *, CASE WHEN grp = 0 THEN 0 ELSE coalesce(lag(ok) OVER w, blank) END AS start, max(ok) OVER (PARTITION BY user_id ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM v WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, event_id)),
f AS (SELECT *, CASE WHEN start IS NOT NULL THEN greatest(start, coalesce(ended, start)) END AS began FROM s)
SELECT user_id, at_ms, end_ms, line FROM f UNION ALL SELECT user_id, began, at_ms, '' FROM f WHERE at_ms - began >= 3000""")
def lines_with_gaps(t):
    at = F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000
    end = F.when(F.col("event_type") == "purchase", at + F.round(F.col("value") * 60000).cast("long") - 300000)
    lines = t.events.select("user_id", "event_id", at.alias("at_ms"), end.alias("end_ms"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("line"))
    return al.with_gaps(lines, "user_id", "at_ms", "end_ms", "line", ["at_ms", "event_id"], 3000)


@query("""
WITH b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events)
SELECT user_id, event_type, min(back) AS back, count(*) AS n FROM b GROUP BY ALL""")
def last_occurrence(t):
    return al.last_occurrence(t.events.select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", [F.desc("ts"), F.desc("event_id")])


@query(f"""
WITH e AS ({EVENTS}),
x AS (SELECT event_id, user_id, ts, greatest(milli - avg(milli) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 0) AS x FROM e),
p AS (SELECT *, avg(x * x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 43 PRECEDING AND 43 FOLLOWING) AS near, avg(x * x) OVER (PARTITION BY user_id) * 0.01 AS floor FROM x)
SELECT event_id, round(CASE WHEN greatest(near, floor) > 0 THEN least(x / sqrt(greatest(near, floor)), 6) ELSE 0 END, 4) AS strength FROM p""")
def local_strength(t):
    rows = t.events.select("event_id", "user_id", "ts", MILLI("value").alias("milli"))
    return al.local_strength(rows, "user_id", "milli", ["ts", "event_id"]).select("event_id", F.round("strength", 4).alias("strength"))


@query(f"""
WITH e AS (SELECT user_id, milli, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ({EVENTS})),
s AS (SELECT a.user_id, a.pos - b.pos AS lag, sum(a.milli * b.milli) / sqrt(CAST(sum(a.milli * a.milli) AS DOUBLE) * sum(b.milli * b.milli)) AS score
      FROM e a JOIN e b ON a.user_id = b.user_id AND a.pos - b.pos BETWEEN 1 AND 12 GROUP BY ALL)
SELECT user_id, CAST(arg_max(lag, (score, -lag)) AS DOUBLE) AS lag, round(max(score), 6) AS score FROM s GROUP BY 1""")
def best_lag(t):
    rows = t.events.select("user_id", "ts", "event_id", MILLI("value").alias("milli"))
    return al.best_lag(rows, "user_id", "milli", ["ts", "event_id"], list(range(1, 13))).withColumn("score", F.round("score", 6))
