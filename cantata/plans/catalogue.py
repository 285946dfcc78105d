"""Catalogue queries: pages, counts, filters, joins of identity, completeness, duplicates, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantata.functions import text as fn
from cantata.operators import catalogue as cat
from cantata.operators import joins, parts
from cantata.operators.names import numbered_conflicts
from cantata.operators.windows import first_per_key, fractional_cap
from cantata.plans.common import Registry

registry = Registry()
query = registry.query


@query("""
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS tracks, CAST(count(*) FILTER (n > 1) AS BIGINT) AS albums, CAST(count(*) FILTER (n = 1) AS BIGINT) AS singles
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def library_counts(t):
    return cat.library_counts(t.lineitem, "l_orderkey")


@query("""
SELECT c_custkey, c_name, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at,
       CASE WHEN max(o_totalprice) >= 300000 THEN 'hires' WHEN max(o_totalprice) >= 100000 THEN 'cd' ELSE 'lossy' END AS class
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
GROUP BY c_custkey, c_name HAVING count(*) > 1 ORDER BY last_at DESC, c_custkey LIMIT 100""")
def album_page(t):
    customers = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")).select("c_custkey", "c_name")
    top = F.max("o_totalprice")
    page = (
        t.orders.groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.when(top >= 300000, "hires").when(top >= 100000, "cd").otherwise("lossy").alias("class"))
        .filter("n > 1")
    )
    return page.join(customers, "c_custkey").select("c_custkey", "c_name", "n", "first_at", "last_at", "class").orderBy(F.desc("last_at"), "c_custkey").limit(100)


@query("""
SELECT nation, CAST(sum(n) AS BIGINT) AS n, max(source) AS last_source FROM (
  SELECT c_nationkey AS nation, count(*) AS n, 'customer' AS source FROM customer GROUP BY 1
  UNION ALL SELECT s_nationkey, count(*), 'supplier' FROM supplier GROUP BY 1) GROUP BY 1""")
def artist_page_merged(t):
    parts = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("source")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source")))
    return parts.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("last_source"))


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice <= 150000.0 AND (o_totalprice < 150000.0 OR (o_totalprice = 150000.0 AND o_orderkey > 100))
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def keyset_page(t):
    return cat.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], 50, [150000.0, 100])


@query("""
SELECT p_partkey, CASE WHEN p_size >= 24 OR p_type LIKE '24%' THEN 'hires' WHEN p_size = 16 OR p_type LIKE '16%' THEN 'cd' ELSE 'lossy' END AS quality FROM part""")
def quality_classes(t):
    return t.part.select("p_partkey", cat.quality_class(F.col("p_size"), F.col("p_type")).alias("quality"))


@query(r"""
SELECT doc_id, (text IS NULL OR trim(text) IN ('', '0') OR lang IS NULL OR trim(lang) IN ('', '0')) AS missing_any,
       regexp_matches(coalesce(text, ''), '[0-9]{4}') AS has_digit_run, NOT starts_with(coalesce(source, ''), 'src1') AS other_source,
       contains(lower(coalesce(text, '')), 'license') AS says_license
FROM documents""")
def metadata_filters(t):
    d = t.documents
    body = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id",
        cat.missing_any(F.col("text"), F.col("lang")).alias("missing_any"),
        body.rlike("[0-9]{4}").alias("has_digit_run"),
        (~F.coalesce("source", F.lit("")).startswith("src1")).alias("other_source"),
        F.contains(F.lower(body), F.lit("license")).alias("says_license"),
    )


@query("""
SELECT 'dl_' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_acctbal, c_mktsegment FROM customer""")
def union_padded(t):
    s = t.supplier.select(F.concat(F.lit("dl_"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND e.event_type = 'error')""")
def not_shadowed(t):
    returned = t.lineitem.filter("l_returnflag = 'R'")
    failed = t.events.filter("event_type = 'error'")
    return joins.not_shadowed(t.orders.select("o_orderkey", "o_custkey"), [("o_orderkey", returned, "l_orderkey"), ("o_custkey", failed, "user_id")])


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS origin_available FROM part")
def origin_flag(t):
    return joins.existence_flag(t.part.select("p_partkey"), "p_partkey", t.lineitem.filter("l_quantity >= 49"), "l_partkey", "origin_available")


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate FROM orders),
asked AS (
  SELECT c_custkey, 0 AS kind, CAST(c_custkey * 3 AS VARCHAR) AS key FROM customer UNION ALL
  SELECT c_custkey, 1, CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 2, CAST(c_nationkey AS VARCHAR) FROM customer),
found AS (
  SELECT 0 AS kind, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS candidate, o_orderdate AS added FROM c WHERE o_orderpriority = '1-URGENT' UNION ALL
  SELECT 1, CAST(o_custkey AS VARCHAR), o_orderkey, o_orderdate FROM c WHERE o_totalprice > 200000 UNION ALL
  SELECT 2, CAST(o_custkey % 25 AS VARCHAR), o_orderkey, o_orderdate FROM c WHERE o_totalprice > 350000)
SELECT c_custkey, kind, candidate FROM (
  SELECT c_custkey, kind, candidate, row_number() OVER (PARTITION BY c_custkey ORDER BY kind, added DESC, candidate DESC) AS rn FROM asked JOIN found USING (kind, key)) WHERE rn = 1""")
def priority_lookup(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").alias("added"))
    candidates = lambda rows, key: rows.select(key.alias("key"), F.col("o_orderkey").alias("candidate"), "added")
    kinds = [
        (F.col("c_custkey") * 3, candidates(o.filter("o_orderpriority = '1-URGENT'"), F.col("o_orderkey"))),
        (F.col("c_custkey"), candidates(o.filter("o_totalprice > 200000"), F.col("o_custkey"))),
        (F.col("c_nationkey"), candidates(o.filter("o_totalprice > 350000"), F.col("o_custkey") % 25)),
    ]
    return joins.priority_lookup(t.customer, "c_custkey", kinds, [F.desc("added"), F.desc("candidate")]).select("c_custkey", "kind", "candidate")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM (SELECT l_orderkey, count(*) AS n, count(p_partkey) AS x FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l
    LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 40) p ON l_partkey = p_partkey GROUP BY 1) WHERE n = x)""")
def division_all(t):
    needed = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    small = t.part.filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    n = parts.parts_for(t.lineitem)
    present = needed.repartition(n, "l_partkey").join(small, "l_partkey", "left_semi").select("o_orderkey", "l_partkey")
    return joins.has_all(t.orders.select("o_orderkey"), "o_orderkey", needed, present, n)


@query("""
WITH l AS (
  SELECT l_orderkey AS album, l_linenumber AS track, l_suppkey, CASE WHEN l_orderkey % 2 = 1 THEN 2 ELSE 1 END AS discs,
         CASE WHEN l_orderkey % 2 = 1 THEN 1 + l_partkey % 2 WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS disc,
         CASE WHEN l_orderkey % 11 = 0 THEN lower(l_returnflag) ELSE '' END AS title
  FROM lineitem),
r AS (
  SELECT album, track, discs, title, greatest(disc, 1) AS d,
         CASE WHEN album % 7 = 0 OR l_suppkey % 10 = 0 THEN NULL ELSE max(track) OVER (PARTITION BY album, disc) END AS total FROM l),
clash AS (SELECT DISTINCT album FROM (SELECT album, d, track FROM r GROUP BY ALL HAVING count(DISTINCT title) > 1)),
c AS (SELECT album, d, count(DISTINCT track) AS present, max(total) AS most, min(total) AS least, max(track) AS last_track, max(discs) AS discs FROM r GROUP BY 1, 2),
a AS (
  SELECT album, sum(present) AS present, sum(most) AS total, min(most) AS lo, max(most) AS hi, count(*) AS seen, max(d) AS last_disc, max(discs) AS discs,
         bool_or(most IS NULL OR least <> most OR last_track > most) AS bad FROM c GROUP BY 1),
e AS (
  SELECT *, bad OR album IN (SELECT album FROM clash) AS uncertain,
         CASE WHEN (last_disc = 1 AND discs = 1) OR (discs = seen AND lo <> hi) THEN total END AS expected FROM a)
SELECT album, CASE WHEN uncertain THEN 'unknown' WHEN discs > seen OR present < coalesce(expected, hi) THEN 'incomplete' WHEN present = expected THEN 'complete' ELSE 'unknown' END AS status,
       CAST(present AS BIGINT) AS present, CASE WHEN NOT uncertain THEN CAST(expected AS BIGINT) END AS expected FROM e""")
def completeness(t):
    two = F.col("album") % 2 == 1
    tracks = t.lineitem.select(F.col("l_orderkey").alias("album"), F.col("l_linenumber").alias("track"), "l_partkey", "l_suppkey", "l_returnflag")
    tracks = tracks.repartition(parts.parts_for(t.lineitem), "album").withColumn("disc", F.when(two, 1 + F.col("l_partkey") % 2).when(F.col("album") % 5 == 0, 0).otherwise(1).cast("int"))
    most = F.max("track").over(Window.partitionBy("album", "disc"))
    tracks = tracks.select(
        "album",
        "track",
        "disc",
        F.when(two, 2).otherwise(1).alias("discs"),
        F.when((F.col("album") % 7 != 0) & (F.col("l_suppkey") % 10 != 0), most).alias("total"),
        F.when(F.col("album") % 11 == 0, F.col("l_returnflag")).alias("title"),
        F.lit(0).alias("unavailable"),
    )
    return cat.completeness(tracks, "album", "track", "total", "disc", "discs", "title", "unavailable")


@query("""
WITH d AS (SELECT doc_id, n_chars, sha256(lower(trim(coalesce(text, '')))) AS dup_key FROM documents WHERE trim(coalesce(text, '')) <> '')
SELECT doc_id, dup_key, copies, rn = 1 AS keep FROM (
  SELECT doc_id, dup_key, count(*) OVER (PARTITION BY dup_key) AS copies, row_number() OVER (PARTITION BY dup_key ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM d) WHERE copies > 1""")
def duplicate_groups(t):
    key = F.nullif(fn.lookup_text(F.col("text")), F.lit(""))  # blank texts are no copies of each other
    d = t.documents.select("doc_id", "n_chars", F.sha2(key, 256).alias("k"))
    return cat.duplicates(d, F.col("k"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")]).select("doc_id", "dup_key", "copies", "keep")


@query("""
SELECT doc_id, lang FROM documents WHERE contains(lower(coalesce(text, '')), 'the') AND contains(lower(coalesce(text, '')), 'shed')
  AND contains(lower(coalesce(text, '')) , 'ing')""")
def multi_term_search(t):
    return t.documents.filter(cat.has_terms("Shed THE ing the", F.col("text"))).select("doc_id", "lang")


@query("""
SELECT p_partkey, rank FROM (SELECT p_partkey, p_name, CASE WHEN lower(trim(p_name)) = 'part 1' THEN 0 WHEN starts_with(lower(trim(p_name)), 'part 1') THEN 1
  WHEN contains(lower(trim(p_name)), 'part 1') THEN 2 ELSE 3 END AS rank FROM part)""")
def search_rank(t):
    return t.part.select("p_partkey", cat.search_rank("Part 1", F.col("p_name")).alias("rank"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example')")
def trigram_search(t):
    pages = t.pages.select("page_id", "url")
    return cat.trigram_search(cat.trigram_index(pages, "page_id", F.col("url")), pages, "page_id", F.col("url"), "Example").select("page_id")


@query("""
WITH p AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(www\\.)?', ''), '[?#].*$', ''), '/') AS identity FROM pages)
SELECT identity, count(*) AS copies, min(page_id) AS keep FROM p GROUP BY 1""".replace("\\\\", "\\"))
def page_identity(t):
    return t.pages.groupBy(fn.url_identity(F.col("url")).alias("identity")).agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("keep"))


@query("""
SELECT nation, region, n FROM (
  SELECT n_name AS nation, r_name AS region, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
WHERE n = 0 OR n > 0""")
def counts_with_zero(t):
    sizes = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    placed = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).join(sizes, "n_nationkey", "left")
    return placed.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT folder, count(*) AS files FROM (
  SELECT array_to_string(parts[1:k], '/') AS folder FROM (SELECT string_split(regexp_replace(url, '^[a-zA-Z]+://', ''), '/') AS parts FROM pages) p, range(1, 20) r(k) WHERE k < len(parts)) GROUP BY 1""")
def folder_rollup(t):
    return cat.ancestor_counts(t.pages, F.regexp_replace("url", "^[a-zA-Z]+://", ""))


@query("""
SELECT s_suppkey, s_name || '/' || CASE WHEN s_nationkey IS NULL THEN '' ELSE CAST(s_nationkey AS VARCHAR) END || ' - ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '.flac' AS path FROM supplier""")
def template_expand(t):
    fields = {"artist": F.col("s_name"), "album": F.col("s_nationkey"), "number": F.lpad(F.col("s_suppkey").cast("string"), 4, "0")}
    return t.supplier.select("s_suppkey", fn.fill_template("{artist}/{album} - {number}.flac", fields).alias("path"))


# a file each for the parts: of every brand many, some with a number in the name already, some in capitals; a few names are taken
_FILE = "CASE WHEN p_partkey % 7 = 0 THEN p_brand || ' (' || (p_partkey % 5 + 2) || ').flac' WHEN p_partkey % 11 = 0 THEN upper(p_brand) || '.FLAC' WHEN p_partkey % 13 = 0 THEN p_brand ELSE p_brand || '.flac' END"


@query(f"""
WITH RECURSIVE wanted AS (
  SELECT p_partkey, lower(p_brand) AS family, {_FILE} AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part),
split AS (
  SELECT *, CASE WHEN contains(file, '.') THEN regexp_extract(file, '^(.*)[.][^.]*$', 1) ELSE file END AS stem, CASE WHEN contains(file, '.') THEN regexp_extract(file, '[.][^.]*$') ELSE '' END AS ending FROM wanted),
there AS (SELECT DISTINCT lower('Brand#' || s_suppkey % 25) AS family, lower('Brand#' || s_suppkey % 25 || ' (' || (s_suppkey % 9 + 1) || ').flac') AS path FROM supplier),
steps AS (
  SELECT family, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS VARCHAR) AS name, coalesce((SELECT list(path) FROM there t WHERE t.family = f.family), []) AS taken
  FROM (SELECT DISTINCT family FROM wanted) f
  UNION ALL
  SELECT family, nth, p_partkey, name, list_append(taken, lower(name)) FROM (
    SELECT w.family, w.nth, w.p_partkey, s.taken,
           list_filter(list_transform(range(1, len(s.taken) + 3), lambda n: CASE WHEN n = 1 THEN w.file ELSE w.stem || ' (' || n || ')' || w.ending END), lambda f: NOT list_contains(s.taken, lower(f)))[1] AS name
    FROM steps s JOIN split w ON w.family = s.family AND w.nth = s.nth + 1))
SELECT p_partkey, name FROM steps WHERE nth > 0""")
def conflict_names(t):
    rows = t.part.select("p_partkey", F.expr(_FILE).alias("file"), F.lit("").alias("folder"))
    there = t.supplier.select(F.expr("'Brand#' || s_suppkey % 25 || ' (' || (s_suppkey % 9 + 1) || ').flac'").alias("path"))
    return numbered_conflicts(rows, "folder", "file", "p_partkey", there).select("p_partkey", "name")


@query("""
SELECT p_partkey, lower(p_name) || '|' || lower(p_brand) AS key, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS shown, lower(p_type) IN ('promo', 'standard') AS listed FROM part""")
def padded_keys(t):
    around = lambda c: F.concat(F.lit("\t\u00a0 "), c, F.lit("\n\u3000"))
    blank = F.when(F.col("p_partkey") % 2 == 0, around(F.col("p_type"))).when(F.col("p_partkey") % 3 == 0, "\t\n").otherwise("\u2003NULL\ufeff")
    key = fn.match_key(around(F.col("p_name")), around(F.upper("p_brand")))
    return t.part.select("p_partkey", key.alias("key"), fn.optional_text(blank).alias("shown"), fn.lookup_text(around(F.col("p_type"))).isin("promo", "standard").alias("listed"))


@query("""
SELECT o_orderkey, o_custkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders)
WHERE place <= ceil(total * 0.001)""")
def diversity_cap(t):
    return fractional_cap(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", "o_custkey", [F.asc("o_orderkey")], 0.001)


@query("""
SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM customer JOIN orders ON c_custkey = o_custkey) WHERE rn = 1""")
def latest_order(t):
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate").join(t.customer.select("c_custkey"), "c_custkey", "left_semi")
    return first_per_key(rows, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("""
SELECT p_partkey, array_to_string([p_name, p_brand, p_type, 'Last'], '|') AS names, CAST(4 AS INTEGER) AS n, contains(' ' || lower(p_name) || ' ', ' part ') AS has_word FROM part""")
def credit_split(t):
    line = F.concat("p_name", F.lit(" Featured "), "p_brand", F.lit("; "), "p_type", F.lit(" & "), F.lower("p_brand"), F.lit(" x Last ft."))
    names = fn.credits(line)
    return t.part.select("p_partkey", F.array_join(names, "|").alias("names"), F.size(names).alias("n"), fn.contains_words(F.lower("p_name"), F.lit("part")).alias("has_word"))


@query("""
WITH parts AS (SELECT p_partkey, string_split(p_type, ' ') AS c, CAST(p_size AS BIGINT) AS amount FROM part)
SELECT credit, CAST(sum(amount) AS BIGINT) AS amount, CAST(round(sum(amount * 1.0 / n) * 1000) AS BIGINT) AS share_milli FROM (
  SELECT unnest(c) AS credit, amount, len(c) AS n FROM parts) GROUP BY 1""")
def credited_amounts(t):
    from cantata.operators.listening import exploded_credits

    sums = exploded_credits(t.part.withColumn("amount", F.col("p_size").cast("long")), F.split("p_type", " "), "amount")
    return sums.select("credit", "amount", F.round(F.col("share") * 1000).cast("long").alias("share_milli"))


@query("""
SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS INTEGER) AS distance, CAST(greatest(length(p_name), length(p_brand)) AS INTEGER) AS longest FROM part""")
def edit_distance(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_brand").alias("distance"), F.greatest(F.length("p_name"), F.length("p_brand")).alias("longest"))
