"""The queries of the training-data operators and, where SQL expresses them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.llm import chat, collocations, exact_dedup, imatch, langid, lexical_search, packing, secrets, sentencepiece_codec, sharding, simhash, token_counts, toxicity
from cantata.llm.common import read, tokenizer_file, trained_on

SHARD_BYTES = 1 << 20
WINDOW = 2048


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    both = sentencepiece_codec.encode_documents(read(spark, sf_dir, "documents"), model, with_decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate_perspectives(read(spark, sf_dir, "conversations"))
    mask = F.concat_ws(";", F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))))
    return views.withColumn("mask", mask).select("conv_id", "speaker", F.col("part").cast("long").alias("part"), "offset", F.col("n_turns").cast("long").alias("n_turns"), "rendered", "mask")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > WINDOW)


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op7_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), WINDOW, end_id=1)


def op9_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit_on_training_part(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~trained_on()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_bloom_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit_on_training_part(docs))
    return found.select("doc_id", (~trained_on()).alias("held_out"), "lang_pred", "score", "coverage")


def op11_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op12_bisection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(read(spark, sf_dir, "documents"))
    found = lexical_search.search(index, spark, read(spark, sf_dir, "benchmark"))
    lexical_search.drop(index, spark)  # what was found is written already
    return found.select("item_id", "rank", "doc_id", "score")


def op13_hashed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_chat_rotation, op3_token_counts, op4_extendible_sharding, op5_imatch, op6_exact_dedup, op7_simhash_pigeonhole, op8_sum_of_squares_packing, op9_pu_toxicity, op10_bloom_language_id, op11_secret_ownership, op12_bisection_search, op13_hashed_collocations)}

#: The patterns of secrets as the SQL has them: either case is written out, as a case-blind match would let in other letters than ASCII's.
_PATTERNS = {"assign": "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + secrets.ASSIGN.partition(")")[2]}
_PATTERNS |= {"access": secrets.ACCESS, "hex": secrets.HEX, "bare": f"[A-Za-z0-9+/_=-]{{{secrets.BARE_LENGTH},}}"}
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLES = {
    "op2_chat_rotation": r"""
WITH named AS (
  SELECT conv_id, turn, replace(CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END, '<|', '< |') AS name,
         replace(coalesce(text, ''), '<|', '< |') AS body, floor(turn / 256) AS bucket
  FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY turn NULLS FIRST, name, body) AS rn FROM named),
parted AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY bucket NULLS FIRST, (rn - 1) // 256) - 1 AS part FROM numbered),
speakers AS (SELECT DISTINCT conv_id, name AS speaker FROM named WHERE name <> 'system'),
segments AS (
  SELECT p.conv_id, s.speaker, p.part, p.rn, p.name = s.speaker AS own,
         '<|im_start|>' || CASE WHEN name = 'system' THEN 'system' WHEN name = speaker THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head,
         body || '<|im_end|>' AS masked
  FROM parted p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(masked) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(head) AS begins
  FROM segments),
views AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || masked || chr(10), '' ORDER BY rn) AS rendered,
         coalesce(string_agg(CASE WHEN own THEN CAST(begins AS BIGINT) || ':' || CAST(begins + length(masked) AS BIGINT) END, ';' ORDER BY rn), '') AS mask
  FROM placed GROUP BY ALL)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(n_turns AS BIGINT) AS n_turns, rendered, mask
FROM views""",
    "op4_extendible_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
b AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM d, range(0, 61) r(depth) GROUP BY ALL),
placed AS (
  SELECT d.doc_id, d.n_bytes, min_by((b.depth, b.prefix, b.shard_bytes, b.shard_docs), b.depth) AS s
  FROM d, b WHERE b.prefix = d.h >> (60 - b.depth) AND (b.shard_bytes <= {SHARD_BYTES} OR b.shard_docs = 1 OR b.depth = 60) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN s[1] = 0 THEN '' ELSE lpad(bin(s[2]), CAST(s[1] AS INTEGER), '0') END AS shard, CAST(s[1] AS INTEGER) AS depth,
       CAST(s[3] AS BIGINT) AS shard_bytes, s[4] AS shard_docs, s[3] <= {SHARD_BYTES} AS fits
FROM placed""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_secret_ownership": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
m AS ({" UNION ALL ".join(f"SELECT doc_id, owner, repository, '{kind}' AS kind, {at} AS nth, regexp_extract_all(text, '{_sql(pattern)}') AS ms, string_split_regex(text, '{_sql(pattern)}') AS ps FROM d" for at, (kind, pattern) in enumerate(_PATTERNS.items()))}),
each AS (SELECT doc_id, owner, repository, kind, nth, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
placed AS (
  SELECT doc_id, owner, repository, kind, nth, ms[i] AS found, length(array_to_string(ps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS begins FROM each),
spans AS (
  SELECT doc_id, owner, repository, kind, nth, begins, begins + length(found) AS ends, CASE WHEN kind = 'assign' THEN regexp_extract(found, '{_sql(_PATTERNS["assign"])}', 2) ELSE found END AS v
  FROM placed),
base AS (SELECT * FROM spans WHERE length(v) >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 WHEN 'hex' THEN 24 ELSE 1000000000 END),
bare AS (
  SELECT * FROM spans s WHERE kind = 'bare' AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.begins < s.ends AND b.ends > s.begins)),
candidates AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (SELECT v, count(DISTINCT owner) >= {secrets.COPIED_OWNERS} OR count(DISTINCT (owner, repository)) >= {secrets.COPIED_REPOS} AS copied FROM candidates GROUP BY v),
told AS (
  SELECT c.*, copied, len(list_distinct(string_split(v, ''))) >= {secrets.DISTINCT} AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')
         AND NOT regexp_matches(lower(v), '{"|".join(secrets.PLACEHOLDERS)}') AS alive
  FROM candidates c JOIN owned USING (v)),
kept AS (SELECT *, kind || ':' || begins || ':' || ends AS said FROM told WHERE kind <> 'bare' OR (alive AND NOT copied)),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(said, ',' ORDER BY begins, nth) FILTER (kind <> 'bare') AS base, string_agg(said, ',' ORDER BY begins, nth) AS spans,
         count(*) FILTER (copied) AS n_copied, count(*) FILTER (alive AND NOT copied) AS n_live
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN by_doc USING (doc_id)""",
    "op12_bisection_search": rf"""
WITH t AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM documents) GROUP BY ALL),
q AS (
  SELECT item_id, term, count(*) AS k
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
all_of AS (SELECT count(DISTINCT doc_id) AS docs, CAST(sum(tf) AS BIGINT) AS words FROM t),
sized AS (SELECT doc_id, 100 - 75 + (75 * CAST(sum(tf) AS BIGINT) * docs) // words AS m FROM t, all_of GROUP BY doc_id, docs, words),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, all_of WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN weighed USING (term) JOIN t USING (term) JOIN sized USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_hashed_collocations": rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWERED}, '[.,;:!?
-
]')), '[^ 	]+') AS ws FROM documents),
sized AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM p, range(1, 4) r(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, x.f AS l, y.f AS r, ws, cut, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(longer) AS longer
  FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a AS longer FROM best WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM best WHERE k = 3)
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sized USING (lang) QUALIFY rank <= 2000""",
}
