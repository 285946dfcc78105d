"""Ranking queries: vocabulary, vectors, features of text, selection, models, signal statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantata.functions import text as fn
from cantata.operators import item_vectors, parts
from cantata.operators import ranking as rk
from cantata.plans.common import Registry

registry = Registry()
query = registry.query


@query(r"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM documents)
GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 3000""")
def vocab_topk(t):
    tokens = t.documents.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), 1)).alias("token"))
    return rk.vocabulary(tokens, "token", 2, 3000)


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 20 = 0)
SELECT q, vec_id, CAST(round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * 10000) AS BIGINT) AS sim FROM q, embeddings WHERE vec_id <> q
QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * 10000) DESC, vec_id) <= 10""")
def cosine_topk(t):
    asked = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return rk.nearest(asked, "q", t.embeddings, "vec_id", "embedding", 10)


@query("""
WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, CAST(round(avg(CAST(x AS DOUBLE)) * 1000000) AS BIGINT) AS millionths FROM e GROUP BY ALL""")
def label_centroids(t):
    means = rk.centroid(t.embeddings, "embedding", ["label"])
    return means.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round(F.col("x") * 1_000_000).cast("long").alias("millionths"))


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
s AS (SELECT dim, avg(x) AS mean, sqrt((var_pop(x) * count(*) + 4) / (count(*) + 4)) AS spread FROM e GROUP BY 1)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, CAST(round((x - mean) / spread * 1000) AS BIGINT) AS z FROM e JOIN s USING (dim)""")
def standardize(t):
    return rk.standardised(t.embeddings, "vec_id", "embedding").select("vec_id", "dim", F.round(F.col("z") * 1000).cast("long").alias("z"))


@query("""
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, count(*) FILTER (n_chars IS NULL) > 0 AS any_unknown FROM documents GROUP BY 1""")
def lang_counts(t):
    unknown = F.count("n_chars") < F.count(F.lit(1))
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), unknown.alias("any_unknown"))


@query(r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\p{Latin}')) AS l, len(regexp_extract_all(coalesce(text, ''), '\p{Cyrillic}')) AS y,
                  len(regexp_extract_all(coalesce(text, ''), '[\p{Han}\p{Hiragana}\p{Katakana}]')) AS k FROM documents)
SELECT doc_id, CASE WHEN greatest(l, y, k) = 0 THEN 'none' WHEN l = greatest(l, y, k) THEN 'latin' WHEN y = greatest(l, y, k) THEN 'cyrillic' ELSE 'cjk' END AS script FROM c""")
def script_guess(t):
    return t.documents.select("doc_id", fn.guess_script(F.coalesce("text", F.lit(""))).alias("script"))


@query("""
SELECT c_custkey, lower(trim(c_name)) || '|' || lower(trim(c_mktsegment)) AS match_key, CAST(crc32 AS BIGINT) AS name_length, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS code,
       length(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) <> 12 AS wrong_code
FROM (SELECT *, length(c_name) AS crc32 FROM customer)""")
def lookup_keys(t):
    return t.customer.select(
        "c_custkey",
        fn.match_key(F.col("c_name"), F.col("c_mktsegment")).alias("match_key"),
        F.length("c_name").cast("long").alias("name_length"),
        fn.isrc(F.col("c_name")).alias("code"),
        fn.isrc_is_wrong(F.col("c_name")).alias("wrong_code"),
    )


@query("""
SELECT o_orderkey, year(o_orderdate) AS year, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade,
       CAST(o_orderkey // 60 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS clock,
       CAST((date_diff('day', DATE '2024-01-01', CAST(o_orderdate AS DATE)) % 28 + 28) % 28 AS INTEGER) AS cycle_day FROM orders""")
def dates_and_clocks(t):
    year = fn.release_year(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cycle = F.pmod(F.datediff(F.to_date("o_orderdate"), F.lit("2024-01-01").cast("date")), F.lit(28))
    return t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), fn.decade(year).alias("decade"), fn.clock(F.col("o_orderkey")).alias("clock"), cycle.alias("cycle_day"))


@query("""
SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE CAST(n AS VARCHAR) || ' B' END AS shown,
       sha256(coalesce(text, '')) AS digest FROM (SELECT doc_id, text, strlen(coalesce(text, '')) * 4 + 1 AS n FROM documents)""")
def sizes_and_digests(t):
    size = F.octet_length(F.coalesce("text", F.lit(""))) * 4 + 1
    return t.documents.select("doc_id", fn.human_bytes(size).alias("shown"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("""
SELECT corr(l_quantity, l_extendedprice) * 0 + CAST(round(corr(l_quantity, l_extendedprice) * 1000000) AS BIGINT) AS pearson, median(l_quantity) AS mid, quantile_cont(l_quantity, 0.9) AS high FROM lineitem""")
def signal_statistics(t):
    return t.lineitem.agg(
        F.round(F.corr("l_quantity", "l_extendedprice") * 1_000_000).alias("pearson"), F.median("l_quantity").alias("mid"), F.percentile("l_quantity", 0.9).alias("high")
    )


@query("""
SELECT o_custkey, o_orderkey, place FROM (
  SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 5""")
def top_per_customer(t):
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", best.alias("place")).filter("place <= 5")


@query("""
SELECT user_id, count(*) AS n, CAST(round(1000 * sqrt(sqrt(count(*))) * sqrt(sqrt(count(*))) * sqrt(sqrt(count(*)))) AS BIGINT) AS weight FROM events GROUP BY 1""")
def sampling_weights(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rk.power_weights(counts, "user_id", "n").select("user_id", "n", F.round(1000 * F.col("weight")).cast("long").alias("weight"))


@query()
def greedy_diverse(t):
    scored = t.orders.select("o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice")
    return rk.greedy_diverse(scored, "o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice", 50, 4)


def _newton_sql(steps: int = 10) -> str:
    """Newton steps for two weights drawn towards 1 by 4, written out one after another."""
    grid = "g AS (SELECT l_returnflag AS k, round(l_discount * 10) AS a, round(l_tax * 10) AS b, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, count(*) AS w FROM lineitem GROUP BY ALL)"
    parts = [grid, "b0 AS (SELECT DISTINCT k, CAST(1 AS DOUBLE) AS p, CAST(1 AS DOUBLE) AS q FROM g)"]
    for i in range(steps):
        parts.append(f"c{i} AS MATERIALIZED (SELECT g.*, p, q, 1 / (1 + exp(-(p * a + q * b))) AS c FROM g JOIN b{i} USING (k))")
        parts.append(
            f"s{i} AS MATERIALIZED (SELECT k, p, q, sum(w * (c - y) * a) + 4 * (p - 1) AS u, sum(w * (c - y) * b) + 4 * (q - 1) AS v, sum(w * c * (1 - c) * a * a) + 4 AS h, "
            f"sum(w * c * (1 - c) * a * b) AS m, sum(w * c * (1 - c) * b * b) + 4 AS n FROM c{i} GROUP BY k, p, q)"
        )
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT k, p - (n * u - m * v) / (h * n - m * m) AS p, q - (h * v - m * u) / (h * n - m * m) AS q FROM s{i})")
    last = f"b{steps}"
    return f"WITH {', '.join(parts)} SELECT k AS l_returnflag, 'a' AS feature, round(p, 6) AS coefficient FROM {last} UNION ALL SELECT k, 'b', round(q, 6) FROM {last}"


@query(_newton_sql())
def prior_logistic(t):
    rows = t.lineitem.select("l_returnflag", F.round(F.col("l_discount") * 10).alias("a"), F.round(F.col("l_tax") * 10).alias("b"), (F.col("l_linestatus") == "F").cast("int").alias("y"), F.lit(1.0).alias("w"))
    return rk.logistic_with_prior(rows, "l_returnflag", ["a", "b"], "y", "w").withColumn("coefficient", F.round("coefficient", 6))


@query()
def thompson(t):
    counts = t.events.groupBy("event_type").agg(F.count(F.when(F.col("value") >= 50, 1)).alias("wins"), F.count(F.when(F.col("value") < 50, 1)).alias("losses"))
    return rk.thompson(counts, "event_type", "wins", "losses", 7)


@query()
def item2vec(t):
    """Songs are props.k, their artists tens of them; a listener's day is a session, an error a skip. All tokens that occur often enough have vectors."""
    song = F.get_json_object("props", "$.k").cast("int")
    strength = F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "purchase", 1.5).otherwise(F.col("value") / 100)
    plays = t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", song.alias("song"), F.floor(song / 10).alias("artist"), strength.alias("strength")).filter("song IS NOT NULL")
    placed = item_vectors.checkpointed(item_vectors.positions(plays, ["user_id", "day"], [F.col("ts"), F.col("event_id")], "song", F.col("strength"), parts.parts_for(t.events)))
    dealt = placed.repartition(parts.parts_for(placed), "user_id", "day")
    met = item_vectors.checkpointed(item_vectors.meetings(dealt, ["user_id", "day"], "song", "artist"))
    tokens = placed.filter("weight > 0").select(F.explode(F.array(F.concat(F.lit("i:"), F.col("song")), F.concat(F.lit("a:"), F.col("artist")))).alias("token"))
    return item_vectors.item_vectors(item_vectors.pairs_of(met), rk.vocabulary(tokens, "token", item_vectors.LEAST_COUNT))


@query("""
WITH e AS (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS song,
         CASE event_type WHEN 'error' THEN -1.0 WHEN 'purchase' THEN 1.5 ELSE value / 100 END AS w FROM events),
r AS (SELECT *, CASE WHEN song IS DISTINCT FROM lag(song) OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS new FROM e WHERE w <> 0 AND song IS NOT NULL WINDOW o AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS nth FROM r),
p AS (SELECT user_id, day, nth, song, max(w) AS w FROM runs GROUP BY ALL),
n AS (SELECT *, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY nth) AS n FROM p),
k AS (SELECT * FROM n WHERE w > 0), s AS (SELECT * FROM n WHERE w < 0),
near AS (SELECT a.song AS x, b.song AS y, sqrt(a.w * b.w) * (4 - (b.n - a.n)) / 3 AS rate FROM k a JOIN k b ON a.user_id = b.user_id AND a.day = b.day AND b.n - a.n BETWEEN 1 AND 3),
apart AS (SELECT s.song AS x, k.song AS y, 0.5 * -s.w * sqrt(k.w) * (4 - CASE WHEN k.n <= s.n THEN s.n - k.n + 1 ELSE k.n - s.n END) / 3 AS rate FROM s JOIN k ON s.user_id = k.user_id AND s.day = k.day AND k.n BETWEEN s.n - 2 AND s.n + 3),
every AS (SELECT x, y, rate, 1 AS label FROM near UNION ALL SELECT y, x, rate, 1 FROM near UNION ALL SELECT x, y, rate, 0 FROM apart UNION ALL SELECT y, x, rate, 0 FROM apart)
SELECT 'i:' || x AS center, 'i:' || y AS context, CAST(label AS DOUBLE) AS label, count(*) AS n, CAST(round(sum(rate) * 1000) AS BIGINT) AS rates FROM every WHERE x <> y GROUP BY ALL""")
def item_pairs(t):
    song = F.get_json_object("props", "$.k").cast("int")
    strength = F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "purchase", 1.5).otherwise(F.col("value") / 100)
    plays = t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", song.alias("song"), strength.alias("strength")).filter("song IS NOT NULL")
    placed = item_vectors.positions(plays, ["user_id", "day"], [F.col("ts"), F.col("event_id")], "song", F.col("strength"), parts.parts_for(t.events))
    return item_vectors.token_pairs(placed, ["user_id", "day"], "song").groupBy("center", "context", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate") * 1000).cast("long").alias("rates"))
