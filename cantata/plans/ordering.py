"""Orders, unions by precedence, sets and filters over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.operators import filters, ordering
from cantata.plans.common import Registry

registry = Registry()
query = registry.query

FIELDS = {"name": "p_name", "artist": "p_brand", "album": "p_type", "added": "added", "release": "p_retailprice", "genre": "p_type", "size": "size", "source": "p_brand", "key": "p_partkey"}


def _sort_sql(mode: str) -> str:
    field, falls = ordering.SORT_MODES[mode]
    way = lambda c, down: f"{FIELDS[c]} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}"
    terms = ["size IS NULL"] * (field == "size") + [way(field, falls), way("artist", falls) if field == "name" else way("name", False), "p_brand", "p_partkey"]
    return f"SELECT '{mode}' AS mode, p_partkey, row_number() OVER (ORDER BY {', '.join(terms)}) AS position FROM p QUALIFY position BETWEEN 11 AND 40"


@query("WITH p AS (SELECT *, p_partkey % 97 AS added, nullif(p_size, 13) AS size FROM part) " + " UNION ALL ".join(map(_sort_sql, ordering.SORT_MODES)))
def sort_modes(t):
    parts = t.part.withColumn("added", F.col("p_partkey") % 97).withColumn("size", F.nullif(F.col("p_size"), F.lit(13)))
    pages = [ordering.page(parts, ordering.sort_terms(m, FIELDS), 30, 10).select(F.lit(m).alias("mode"), "p_partkey", "position") for m in ordering.SORT_MODES]
    return reduce(DataFrame.unionByName, pages)


@query("""
SELECT kind, id, balance FROM (
  SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier)
ORDER BY balance DESC, kind, id LIMIT 40""")
def branch_page(t):
    customers = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return ordering.branch_page([customers, suppliers], [F.desc("balance"), F.asc("kind"), F.asc("id")], 40)


LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, nullif(CAST(l_quantity AS INTEGER) % 3, 0) AS disc, nullif(l_linenumber, 4) AS track"


def _lines(t):
    disc, track = F.nullif(F.col("l_quantity").cast("int") % 3, F.lit(0)), F.nullif(F.col("l_linenumber"), F.lit(4))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", disc.alias("disc"), track.alias("track"))


@query(f"""
WITH l AS (SELECT {LINES} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(disc, 1), coalesce(track, 999), lower(trim(l_returnflag)), l_linenumber, l_partkey, l_suppkey) AS place FROM l""")
def album_order(t):
    from pyspark.sql import Window

    order = [*ordering.album_order(F.col("disc"), F.col("track"), F.col("l_returnflag")), "l_linenumber", "l_partkey", "l_suppkey"]
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))  # an order has few lines
    return _lines(t).withColumn("place", place).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query(f"""
WITH l AS (SELECT {LINES} FROM lineitem),
f AS (SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AND count(track) = count(*) AS numbered FROM l GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN numbered THEN coalesce(disc, 0) ELSE 0 END AS by_disc, CASE WHEN numbered THEN coalesce(track, 0) ELSE 0 END AS by_track,
  lower(l_returnflag) AS by_name FROM l JOIN f USING (l_orderkey)""")
def folder_order(t):
    ordered = ordering.folder_order(_lines(t), "l_orderkey", "l_returnflag", "disc", "track", "l_returnflag")
    return ordered.select("l_orderkey", "l_partkey", "l_suppkey", "by_disc", "by_track", "by_name")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) + 999 AS stamp FROM events""")
def rewrite_stamps(t):
    rows = t.events.select("user_id", "event_id", "value")
    return ordering.rewrite_stamps(rows, ["user_id"], F.col("value"), ["value", "event_id"], 1000).select("user_id", "event_id", "stamp")


@query("""
SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('2024-01-16|' || c_custkey, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS shuffle FROM customer""")
def daily_shuffle(t):
    return t.customer.select("c_custkey", ordering.shuffle_key("2024-01-16", F.col("c_custkey")).alias("shuffle"))


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS bucket FROM orders""")
def priority_key(t):
    return t.orders.select("o_orderkey", ordering.priority_key(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).alias("bucket"))


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def newest_ids(t):
    return ordering.newest_ids(t.events.select("event_id", "event_type"), "event_id", 500)


RAW_DATES = {0: "{d}", 1: "{y}", 2: "{m}", 3: "{y}-13", 4: "{y}-02-30", 5: "{d}T10:00:00", 6: "0000", 7: " {m} ", 8: "{d}Tnoon", 9: "about {y}"}


def _raw_date_sql(shape: str) -> str:
    return "'" + shape.replace("{d}", "' || d || '").replace("{m}", "' || substr(d, 1, 7) || '").replace("{y}", "' || substr(d, 1, 4) || '") + "'"


@query(
    "WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 10 "
    "WHEN 0 THEN CAST(replace(d, '-', '') AS INTEGER) WHEN 5 THEN CAST(replace(d, '-', '') AS INTEGER) WHEN 1 THEN CAST(substr(d, 1, 4) || '0101' AS INTEGER) "
    "WHEN 2 THEN CAST(replace(substr(d, 1, 7), '-', '') || '01' AS INTEGER) WHEN 7 THEN CAST(replace(substr(d, 1, 7), '-', '') || '01' AS INTEGER) ELSE 0 END AS key FROM o"
)
def partial_dates(t):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    kinds = {"{d}": d, "{m}": F.substring(d, 1, 7), "{y}": F.substring(d, 1, 4)}
    raw = F.lit(None).cast("string")
    for i, shape in RAW_DATES.items():
        mark = next((k for k in kinds if k in shape), None)
        before, _, after = shape.partition(mark) if mark else (shape, "", "")
        text = F.concat(F.lit(before), kinds[mark], F.lit(after)) if mark else F.lit(before)
        raw = F.when(F.col("o_orderkey") % 10 == i, text).otherwise(raw)
    return t.orders.select("o_orderkey", ordering.partial_date_key(raw).alias("key"))


@query("""
SELECT kind, id, max(seen) AS seen FROM (
  SELECT 'user' AS kind, user_id AS id, ts AS seen FROM events UNION ALL SELECT 'customer', o_custkey, o_orderdate FROM orders)
GROUP BY ALL ORDER BY seen DESC, kind, id LIMIT 10""")
def merged_recents(t):
    users = t.events.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("ts").alias("seen"))
    customers = t.orders.select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("seen"))
    return ordering.merged_recents([users, customers], ["kind", "id"], "seen", 10)


@query("""
WITH e AS (SELECT o_orderdate AS d, o_orderkey AS k FROM orders WHERE o_orderkey IN (7, 3))
SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) BETWEEN (SELECT (d, k) FROM e ORDER BY d, k LIMIT 1) AND (SELECT (d, k) FROM e ORDER BY d DESC, k DESC LIMIT 1)""")
def between_items(t):
    return ordering.between_items(t.orders, "o_orderkey", ["o_orderdate", "o_orderkey"], 7, 3).select("o_orderkey")


@query("SELECT 1 AS strategy, p_partkey FROM part WHERE p_name = 'red widget'")
def first_with_rows(t):
    p = t.part
    return ordering.first_with_rows([p.filter(F.col(c) == v).select("p_partkey") for c, v in (("p_brand", "none"), ("p_name", "red widget"), ("p_type", "ECONOMY"))])


@query("""
SELECT nation, id, part FROM (
  SELECT s_nationkey AS nation, s_suppkey AS id, 0 AS part FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer)
QUALIFY row_number() OVER (PARTITION BY nation ORDER BY part, id) = 1""")
def first_wins(t):
    suppliers = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return ordering.first_wins([suppliers, t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))], ["nation"], "id")


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 - 60 + 1000 * count(*) OVER ()) % count(*) OVER () AS spot FROM customer),
f AS (SELECT *, spot <> min(spot) OVER (PARTITION BY c_nationkey) AS again FROM c)
SELECT c_custkey, row_number() OVER (ORDER BY again, spot) AS pick FROM f QUALIFY pick <= 30""")
def distinct_first(t):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return ordering.distinct_first(rows, "c_nationkey", "c_acctbal", ["c_acctbal", "c_custkey"], 30, 2).select("c_custkey", "pick")


@query("SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45")
def shadow_pairs(t):
    pair = ["l_partkey AS part", "l_suppkey AS supplier"]
    return t.lineitem.filter("l_returnflag = 'R'").selectExpr(*pair).union(t.lineitem.filter("l_quantity > 45").selectExpr(*pair)).distinct()


@query("SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def common_parts(t):
    return t.lineitem.filter("l_returnflag = 'R'").selectExpr("l_partkey AS part").intersect(t.lineitem.filter("l_quantity > 45").selectExpr("l_partkey AS part"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def unreferenced(t):
    return filters.unreferenced(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey")


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' OGG' WHEN 1 THEN 'Vorbis' WHEN 2 THEN 'ec-3' WHEN 3 THEN NULL ELSE 'flac' END AS format,
  '/m/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.OGG' ELSE '.flac' END AS path FROM documents)
SELECT doc_id, coalesce(lower(replace(trim(format), '-', '_')) IN ('ogg', 'vorbis'), false) OR lower(path) LIKE '%.ogg' OR lower(path) LIKE '%.vorbis' AS ogg,
  coalesce(lower(replace(trim(format), '-', '_')) IN ('eac3', 'ec_3'), false) AS eac3 FROM d""")
def format_filter(t):
    format_ = F.get(F.array(F.lit(" OGG"), F.lit("Vorbis"), F.lit("ec-3"), F.lit(None), F.lit("flac")), (F.col("doc_id") % 5).cast("int"))
    path = F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".OGG").otherwise(".flac"))
    return t.documents.select("doc_id", filters.has_format("ogg", format_, path).alias("ogg"), filters.has_format("EAC3", format_, path).alias("eac3"))


@query("""
SELECT d.doc_id, quality IS NOT NULL AND coalesce(toxic, 0) = 0 AS lacks, coalesce(quality, 0) = 0 AS unknown_or_none, d.doc_id > 100 AS recent,
  NOT coalesce(regexp_matches(source, '(?i)^(web|forum)'), false) AS listed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def known_filters(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return d.select(
        "doc_id", filters.confirmed_missing(F.col("quality").isNotNull(), F.col("toxic")).alias("lacks"), filters.lacks(F.col("quality")).alias("unknown_or_none"),
        filters.since(F.col("doc_id"), F.lit(100)).alias("recent"), filters.not_like(F.col("source"), "^(web|forum)").alias("listed"),
    )


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1 AND CAST(o_orderdate AS DATE) > DATE '1998-06-01' AND CAST(o_orderdate AS DATE) <= DATE '1998-07-01'""")
def release_window(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 3 == 1, F.substring(day, 1, 7)).otherwise(day)
    return t.orders.filter(filters.released_within(raw, "1998-07-01", 30)).select("o_orderkey")
