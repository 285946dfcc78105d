"""Maintenance of tables and text rules over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantata.functions import text as fn
from cantata.operators import maintenance as keep
from cantata.plans.common import Registry

registry = Registry()
query = registry.query


@query("SELECT c_custkey FROM customer WHERE c_custkey <= 900 AND c_nationkey % 2 = 1 AND c_custkey % 5 <> 0")
def confirmed_gone(t):
    listed = t.customer.select("c_custkey", F.col("c_name").alias("path"), "c_nationkey")
    moved = F.when(F.col("c_custkey") % 5 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    now, existing = listed.withColumn("path", moved), listed.filter("c_nationkey % 2 = 0")
    return keep.confirmed_gone(listed, "c_custkey", "path", now, existing, 900)


@query("""
SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_custkey, 'p' || (c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) AS path, c_nationkey
FROM customer WHERE c_custkey % 10 <> 1""")
def relink(t):
    n = F.col("c_custkey")
    table = t.customer.select("c_custkey", F.concat(F.lit("p"), n.cast("string")).alias("path"), "c_nationkey")
    old = F.concat(F.when(n % 10 == 0, "p").otherwise("no"), n.cast("string"))  # what no row has moves nothing
    moves = t.customer.filter("c_custkey % 5 = 0").select(old.alias("old_path"), F.concat(F.lit("p"), F.when(n % 10 == 0, n + 1).otherwise(n).cast("string")).alias("new_path"))
    return keep.relink(table, "c_custkey", "path", moves, F.substring("new_path", 2, 20).cast("long"))


@query("""
WITH u AS (SELECT s_suppkey + 100000 AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey // 2 * 3 END AS code, 'n' || (s_nationkey + s_suppkey // 50) AS name, s_nationkey * 7 AS also FROM supplier),
o AS (SELECT c_custkey AS id, c_custkey AS code, 'n' || (c_custkey % 40) AS name, c_custkey + 5 AS also FROM customer),
e AS (SELECT *, 0 AS new FROM o UNION ALL SELECT *, 1 FROM u)
SELECT id, code, name, also FROM e WHERE NOT EXISTS (
  SELECT 1 FROM u WHERE (e.new = 0 OR u.id > e.id) AND (u.code = e.code OR u.also = e.also OR (u.code IS NULL AND u.also IS NULL AND u.name = e.name)))""")
def merge_by_any_key(t):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    name = lambda n: F.concat(F.lit("n"), n.cast("string")).alias("name")
    old = t.customer.select(c.alias("id"), c.alias("code"), name(c % 40), (c + 5).alias("also"))
    new = t.supplier.select((s + 100000).alias("id"), F.when(s % 4 > 0, F.floor(s / 2) * 3).alias("code"), name(F.col("s_nationkey") + F.floor(s / 50)), (F.col("s_nationkey") * 7).cast("long").alias("also"))
    return keep.merge_by_any_key(old, new, [F.col("code"), F.col("also")], "id", F.col("name"))


@query("""
WITH u AS (SELECT s_suppkey + 100000 AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey // 2 * 3 END AS code, 'n' || s_nationkey AS name FROM supplier),
e AS (SELECT c_custkey AS id, c_custkey AS code, 'n' || (c_custkey % 40) AS name, 0 AS new FROM customer UNION ALL SELECT *, 1 FROM u)
SELECT id, code, name FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE (e.new = 0 OR u.id > e.id) AND (u.code = e.code OR (u.code IS NULL AND u.name = e.name)))""")
def merge_by_name_where_no_code(t):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    name = lambda n: F.concat(F.lit("n"), n.cast("string")).alias("name")
    old = t.customer.select(c.alias("id"), c.alias("code"), name(c % 40))
    new = t.supplier.select((s + 100000).alias("id"), F.when(s % 3 > 0, F.floor(s / 2) * 3).alias("code"), name(F.col("s_nationkey")))
    return keep.merge_by_any_key(old, new, [F.col("code")], "id", F.col("name"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 10 THEN greatest(p_size, coalesce(m, 0)) ELSE p_size END AS p_size
FROM part LEFT JOIN (SELECT l_partkey, max(CAST(l_quantity AS INTEGER)) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""")
def raise_versions(t):
    scans = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("scanned"))
    return keep.raise_versions(t.part.select("p_partkey", "p_size"), "p_partkey", "p_size", scans, 10)


@query("SELECT 1 AS id, max(n_nationkey) AS position, 'paused' AS status FROM nation")
def put_state(t):
    state = t.nation.agg(F.lit(1).alias("id"), F.max("n_nationkey").alias("position"), F.lit("playing").alias("status"))
    return keep.put_state(state, status="paused")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_rows_of(t):
    wanted = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return keep.first_rows_of(t.orders, "o_custkey", wanted, ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
WITH r AS (SELECT *, floor(p_partkey * 8000.0 / p_size / 1000 + 0.5) AS raw FROM part WHERE p_type = 'ECONOMY'),
k AS (SELECT *, CASE WHEN p_size * 1000 >= 10000 THEN p_size ELSE p_size * 1000 END AS t, CASE WHEN raw >= 10000 THEN floor(raw / 1000 + 0.5) ELSE raw END AS e FROM r)
SELECT p_partkey, CASE WHEN t >= 16 THEN t END AS told, CASE WHEN e >= 16 AND p_partkey > 0 THEN CAST(e AS INTEGER) END AS estimated,
  CASE WHEN p_size % 3 = 0 THEN 'ECONOMY ' || p_size || 'kbps' WHEN p_size % 3 = 1 THEN p_size || '-bit/' || CASE WHEN p_size % 2 = 0 THEN '96' ELSE '44.1' END || 'kHz' ELSE 'Best' END AS label, p_size % 3 = 2 AS placeholder
FROM k""")
def rates_and_labels(t):
    s = F.col("p_size")
    label = fn.quality_label(F.when(s % 3 == 1, s), F.when(s % 2 == 0, 96000).otherwise(44100), F.when(s % 3 == 0, s), F.lower("p_type"), F.lit(" Best "))
    p = t.part.filter("p_type = 'ECONOMY'").withColumn("label", label)
    return p.select("p_partkey", fn.kbps(s * 1000).alias("told"), fn.average_kbps(F.col("p_partkey") * 1000, s).alias("estimated"), "label", fn.is_placeholder_label(F.col("label")).alias("placeholder"))


@query("""
SELECT event_id, CASE WHEN event_id % 6 < 5 THEN event_type END AS tag, CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'INFO' WHEN 3 THEN 'DEBUG' ELSE 'INFO' END AS level FROM events""")
def log_lines(t):
    said = F.get(F.array(*map(F.lit, ("it Failed, found", "a Warning: found", "Match found", "trying again", "nothing else", "[] plain"))), (F.col("event_id") % 6).cast("int"))
    line = F.when(F.col("event_id") % 6 < 5, F.concat(F.lit("["), "event_type", F.lit("] "), said)).otherwise(said)
    return t.events.select("event_id", fn.log_tag(line).alias("tag"), fn.log_level(line).alias("level"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) AS s FROM part)
SELECT p_partkey, round(CASE WHEN s < 66 THEN greatest(0, (s - 30) / 2) ELSE least(s * CAST(0.3 AS DOUBLE), s - 30) END, 4) AS first_at, round(CASE WHEN s < 66 THEN NULL ELSE least(s * CAST(0.6 AS DOUBLE), s - 30) END, 4) AS second_at FROM p""")
def window_offsets(t):
    offsets = fn.window_offsets(F.col("p_size") * 3.0, 30.0)
    return t.part.select("p_partkey", F.round(F.get(offsets, F.lit(0)), 4).alias("first_at"), F.round(F.get(offsets, F.lit(1)), 4).alias("second_at"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN 'AAAA' || right(c_name, 9) || right(c_name, 9) END AS id FROM customer")
def catalogue_ids(t):
    id_ = F.concat(F.lit("AAAA"), F.substring("c_name", -9, 9), F.substring("c_name", -9, 9))
    forms = F.array(F.concat(F.lit(" "), id_), F.concat(F.lit("music:track:"), id_), F.concat(F.lit("https://open.music.example/track/"), id_, F.lit("?si=1")), F.concat(F.lit("https://other.example/track/"), id_))
    return t.customer.select("c_custkey", fn.catalogue_id(F.get(forms, (F.col("c_custkey") % 4).cast("int")), "music", "music.example").alias("id"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.5 WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 THEN 0.0 ELSE round(least(1.0, greatest(0.0, (o_orderkey % 128 - 8) / 100.0)), 2) END AS progress FROM orders""")
def shown_progress(t):
    k = F.col("o_orderkey")
    new = F.when(k % 3 == 0, "finalizing").when(k % 3 == 1, "preparing").otherwise("downloading")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("downloading")
    return t.orders.select("o_orderkey", fn.shown_progress(status, F.lit(0.5), new, (k % 128 - 8) / 100.0).alias("progress"))
