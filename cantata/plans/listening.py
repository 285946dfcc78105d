"""Listening queries: daily totals, sessions, streaks, comparisons of periods, intervals, ranks, incremental upkeep."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cantata.operators import joins
from cantata.operators import listening as ls
from cantata.operators import maintenance as keep
from cantata.operators import windows as wn
from cantata.plans.common import Registry

registry = Registry()
query = registry.query

MILLI = lambda c: F.round(c * 1000).cast("long")  # noqa: E731  values have two decimals: sums are exact as integers
IN_ORDER = ["ts", "event_id"]


@query("""
SELECT CAST(ts AS DATE) AS day, user_id, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS amount, count(*) AS plays
FROM events GROUP BY 1, 2""")
def daily_totals(t):
    return ls.daily_totals(t.events, "ts", ["user_id"], MILLI(F.col("value")))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_at,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_purchase
FROM events GROUP BY 1""")
def latest_per_user(t):
    at = F.struct("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", at)
    return t.events.groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.max("ts").alias("last_at"), F.max_by("value", bought).alias("last_purchase"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
i AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d)
SELECT user_id, max(n) AS streak FROM (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1""")
def longest_streak(t):
    return wn.longest_streak(t.events.select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("""
WITH l AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN latest IS NULL OR ts - latest > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session FROM l""")
def sessions_30m(t):
    return wn.sessions(t.events, "user_id", "ts", [F.asc("event_id")], 1800).select("event_id", "user_id", "session")


@query("""
WITH c AS (SELECT user_id, event_type, event_id, value, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, max(value) AS weight FROM r GROUP BY ALL""")
def collapse_repeats(t):
    return wn.collapse_repeats(t.events, "user_id", "event_type", IN_ORDER, "value")


@query("""
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS INTEGER) AS back, round(pow(0.75, back), 9) AS weight
FROM events QUALIFY back < 12""")
def recent_dozen(t):
    recent = wn.recency_decay(t.events, "user_id", [F.desc("ts"), F.desc("event_id")], 12, 0.75)
    return recent.select("event_id", "user_id", "back", F.round("weight", 9).alias("weight"))


@query("""
WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT a.event_type AS center, b.event_type AS context, count(*) AS n
FROM o a JOIN o b ON a.user_id = b.user_id AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 GROUP BY ALL""")
def context_counts(t):
    return wn.context_pairs(t.events, "user_id", "event_type", IN_ORDER, 3).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, user_id, bucket FROM (
  SELECT event_id, user_id, CAST(floor(value / 10) AS BIGINT) AS bucket, lag(CAST(floor(value / 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS NULL OR before <> bucket""")
def bucket_changes(t):
    return wn.bucket_changes(t.events, "user_id", F.floor(F.col("value") / 10), IN_ORDER).select("event_id", "user_id", "bucket")


@query("""
WITH v AS (SELECT event_id, user_id, CAST(round(value * 1000) AS BIGINT) AS milli, ts FROM events),
w AS (SELECT *, max(milli) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top,
             avg(milli) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS mean FROM v)
SELECT event_id, user_id, milli FROM w WHERE milli = top AND milli >= 1.5 * mean""")
def local_peaks(t):
    milli = t.events.select("event_id", "user_id", "ts", MILLI(F.col("value")).alias("milli"))
    return wn.local_peaks(milli, "user_id", "milli", IN_ORDER, 3, 16, 1.5).select("event_id", "user_id", "milli")


@query("""
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events""")
def interleave(t):
    rows = t.events.select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return wn.interleave(rows, "event_type", F.col("at"), ["at", "event_id"]).select("event_type", "event_id", "turn")


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(round(value * 1000) AS BIGINT) AS amount FROM events),
s AS (SELECT user_id, CAST(sum(CASE WHEN day >= DATE '2024-01-16' THEN amount ELSE 0 END) AS BIGINT) AS current,
             CAST(sum(CASE WHEN day < DATE '2024-01-16' THEN amount ELSE 0 END) AS BIGINT) AS previous
      FROM d WHERE day >= DATE '2024-01-02' AND day < DATE '2024-01-30' GROUP BY 1)
SELECT user_id, current, previous, CASE WHEN previous <> 0 THEN CAST(round((current - previous) * 100 / previous) AS BIGINT) END AS change FROM s""")
def rewind_compare(t):
    daily = ls.daily_totals(t.events, "ts", ["user_id"], MILLI(F.col("value")))
    return ls.compare_periods(daily, "day", "amount", datetime.date(2024, 1, 30), 14, ["user_id"]).withColumn("change", F.round("change").cast("long"))


@query("""
WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1)
SELECT user_id, first_day FROM f WHERE first_day >= DATE '2024-01-02' AND first_day < DATE '2024-01-30' AND EXISTS (SELECT 1 FROM f WHERE first_day < DATE '2024-01-02')""")
def new_entities(t):
    return ls.new_entities(t.events.select("user_id", F.to_date("ts").alias("day")), "user_id", "day", datetime.date(2024, 1, 2), datetime.date(2024, 1, 30))


@query("""
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders GROUP BY ALL)
SELECT month, o_custkey, amount FROM m QUALIFY row_number() OVER (PARTITION BY month ORDER BY amount DESC, o_custkey) = 1""")
def monthly_top(t):
    spent = t.orders.select("o_orderdate", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ls.leader_per_month(spent, "o_orderdate", "o_custkey", "cents")


@query("""
SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS amount
FROM events GROUP BY 1 ORDER BY days DESC, amount DESC, user_id LIMIT 10""")
def loyal(t):
    facts = t.events.select("user_id", F.to_date("ts").alias("day"), MILLI(F.col("value")).alias("amount"))
    return ls.most_loyal(facts, "user_id", "day", "amount", 10)


@query("""
SELECT isodow(ts) AS weekday, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS plays FROM events GROUP BY 1""")
def weekday_totals(t):
    day = F.to_date("ts")
    return t.events.groupBy((F.weekday(day) + 1).cast("long").alias("weekday")).agg(F.count_distinct(day).alias("days"), F.count(F.lit(1)).alias("plays"))


@query("""
WITH spans AS (SELECT event_id, ts AS a, ts + to_seconds(CAST(value * 3600 AS INTEGER)) AS b FROM events WHERE event_type = 'view'),
days AS (SELECT event_id, a, b, CAST(unnest(generate_series(date_trunc('day', a), b, INTERVAL 1 DAY)) AS DATE) AS day FROM spans WHERE b > a)
SELECT event_id, day, CAST(floor(epoch(least(b, CAST(day + 1 AS TIMESTAMP)))) - floor(epoch(greatest(a, CAST(day AS TIMESTAMP)))) AS BIGINT) AS seconds FROM days
WHERE CAST(floor(epoch(least(b, CAST(day + 1 AS TIMESTAMP)))) - floor(epoch(greatest(a, CAST(day AS TIMESTAMP)))) AS BIGINT) > 0""")
def split_at_midnight(t):
    seconds = F.round(F.col("value") * 3600).cast("int")
    spans = t.events.filter("event_type = 'view'").select("event_id", F.col("ts").alias("a"), (F.col("ts") + F.make_interval(secs=seconds)).alias("b"))
    return ls.split_at_midnight(spans, "a", "b", ["event_id"])


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(event_id) AS viewed FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, v.viewed FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_join(t):
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = t.events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("viewed"))
    return joins.as_of(bought, seen, "user_id", "ts", ["viewed"]).select("event_id", "user_id", "viewed")


@query("""
WITH p AS (SELECT event_id, user_id, epoch_ms(ts) AS moment FROM events WHERE event_type = 'click'),
i AS (SELECT event_id AS span_id, user_id, epoch_ms(ts) AS a, epoch_ms(ts) + 7200000 AS b FROM events WHERE event_type = 'signup')
SELECT p.event_id, i.span_id FROM p JOIN i ON p.user_id = i.user_id AND a <= moment AND moment < b""")
def interval_join(t):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    points = t.events.filter("event_type = 'click'").select("event_id", "user_id", at.alias("at"))
    spans = t.events.filter("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", at.alias("a"), (at + 7_200_000).alias("b"))
    return joins.stabbing(points, spans, "user_id", "at", "a", "b", 3_600_000).select("event_id", "span_id")


@query("""
WITH l AS (SELECT event_id AS line, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS la FROM events WHERE event_type = 'view'),
s AS (SELECT event_id AS extra, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sa FROM events WHERE event_type = 'error'),
n AS (SELECT line, extra, user_id, la, sa, abs(la - sa) AS distance FROM l JOIN s USING (user_id) WHERE abs(la - sa) <= 3600),
m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id, extra ORDER BY distance, la, line) = 1)
SELECT line, extra, CAST(distance AS BIGINT) AS distance FROM m QUALIFY row_number() OVER (PARTITION BY user_id, line ORDER BY distance, sa, extra) = 1""")
def nearest_within(t):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    lines = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("line"), "user_id", at.alias("la"))
    extras = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("extra"), "user_id", at.alias("sa"))
    return joins.nearest_within(lines, extras, "user_id", "la", "sa", "line", "extra", 3600).select("line", "extra", "distance")


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS ok FROM events""")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.from_json("props", "k int").isNotNull().alias("ok"))


@query("""
WITH base AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT * FROM new UNION ALL SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def merge_excluding(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    updates = o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))
    return keep.merge_excluding(o.filter("o_orderkey % 3 <> 0"), updates, "o_orderkey", returned)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change
FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0 AND o_orderstatus IS DISTINCT FROM 'X')""")
def changed_set(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    new = o.filter("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return keep.difference(o.filter("o_orderkey % 7 <> 0"), new, "o_orderkey", "o_orderstatus")


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS plays, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'seen' END AS art FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(plays) AS BIGINT) AS plays, arg_max(art, o) FILTER (art IS NOT NULL) AS art FROM (
  SELECT user_id, plays, art, 0 AS o FROM (SELECT user_id, sum(plays) AS plays, max(art) AS art FROM s WHERE day < DATE '2024-01-20' GROUP BY 1)
  UNION ALL SELECT user_id, plays, art, 1 FROM (SELECT user_id, sum(plays) AS plays, max(art) AS art FROM s WHERE day >= DATE '2024-01-20' GROUP BY 1)) GROUP BY 1""")
def upsert_totals(t):
    art = F.max(F.when(F.col("event_type") == "view", "seen"))
    part = lambda late: t.events.filter((F.to_date("ts") >= datetime.date(2024, 1, 20)) == late).groupBy("user_id").agg(F.count(F.lit(1)).alias("plays"), art.alias("art"))
    return ls.upsert_totals(part(F.lit(False)), part(F.lit(True)), ["user_id"], ["plays"], ["art"])


@query("""
WITH d AS (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(n_chars) OVER (PARTITION BY source) AS t FROM documents)
SELECT doc_id, n_chars FROM d WHERE t - coalesce(b, 0) > 50000""")
def lru_evict(t):
    return wn.evict_to_budget(t.documents.select("doc_id", "source", "n_chars"), "source", "n_chars", F.col("doc_id"), ["doc_id"], 50000).select("doc_id", "n_chars")


@query("""
SELECT l_orderkey, CAST(round(1000 * 10 * log10(sum(pow(10.0, -l_discount * 10) * l_quantity) / sum(l_quantity))) AS BIGINT) AS level_milli, max(l_tax) AS peak
FROM lineitem GROUP BY 1""")
def weighted_power_mean(t):
    level = ls.power_mean_level(t.lineitem, ["l_orderkey"], -F.col("l_discount") * 100, F.col("l_quantity"))
    peaks = t.lineitem.groupBy("l_orderkey").agg(F.max("l_tax").alias("peak"))
    return level.join(peaks, "l_orderkey").select("l_orderkey", F.round(1000 * F.col("level")).cast("long").alias("level_milli"), "peak")


@query("""
WITH s AS (SELECT d.n_chars, l.toxic FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM s)
SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n,
       CAST(round(1000000 * (sum(rk) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0)
       / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic <> 1))) AS BIGINT) AS auc_millionths FROM r""")
def auc_ties(t):
    scored = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return wn.auc(scored, "n_chars", "toxic").select("p", "n", F.round(F.col("auc") * 1_000_000).cast("long").alias("auc_millionths"))


@query("""
SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS rk FROM customer""")
def average_rank(t):
    return wn.average_rank(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", "rk").select("c_custkey", "rk")


@query("""
SELECT o_orderpriority AS status, count(*) AS n, min(o_orderkey) AS first_key, count(*) FILTER (o_orderstatus = 'F') AS settled FROM orders GROUP BY 1""")
def status_counts(t):
    settled = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return t.orders.groupBy(F.col("o_orderpriority").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), settled.alias("settled"))


@query("""
SELECT o_orderpriority, CAST(ntile(8) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS stratum, o_orderkey FROM orders""")
def strata(t):
    return wn.strata(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", F.col("o_orderkey"), ["o_orderkey"], 8).select("o_orderpriority", "stratum", "o_orderkey")
