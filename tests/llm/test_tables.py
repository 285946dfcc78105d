"""Chat views, shards, I-Match and exact copies: SQL over whole tables, odd rows, and the pipeline as a whole."""

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cantata.llm import chat, exact_dedup, graph, imatch, queries, sharding
from cantata.llm.common import tokenizer_file
from tests.differential import DATA, compare, connect
from tests.llm.test_simhash import plain_similar

FOLDER = f"{DATA}/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "Ab"), (5, "Ab"), (None, "A  b"), (6, "x" * 100_000), (7, "né"), (8, "né")]


def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("salt", F.lit("clash"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None


def test_exact_copies_of_odd_rows(spark):
    rows = exact_dedup.exact_duplicates(odd_docs(spark)).collect()
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert got == [(0, None, 4, True), (1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, None, 4, False), (5, None, 4, False), (5, None, 4, False), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert exact_dedup.exact_duplicates(odd_docs(spark).limit(0)).collect() == []
    for salts in (1, 64):
        assert exact_dedup.exact_duplicates(odd_docs(spark), salts=salts).count() == len(ODD)


def test_shards_of_odd_rows(spark):
    rows = sharding.assign_shards(odd_docs(spark), 8).collect()
    assert len(rows) == len(ODD)
    sizes = {}
    for r in rows:
        assert r["shard_bytes"] <= 8 or not r["fits"]
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
    assert all(sizes[r["shard"]] == r["shard_bytes"] for r in rows)
    shards = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))  # no shard lies within another
    assert {r["shard"] for r in sharding.assign_shards(odd_docs(spark), 10**9).collect()} == {""}
    assert sharding.assign_shards(odd_docs(spark).limit(0), 8).collect() == []


def test_rows_without_an_id_are_parted(spark):
    hot = spark.createDataFrame([(None, "x" * 100)] * 2000 + [(1, "y" * 50)] * 30 + [(2, "z" * 5000)], "doc_id long, text string")
    rows = sharding.assign_shards(hot, 1000).collect()
    sizes, docs = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
        docs[r["shard"]] = docs.get(r["shard"], 0) + 1
    assert len(rows) == 2031 and all(sizes[r["shard"]] == r["shard_bytes"] and docs[r["shard"]] == r["shard_docs"] for r in rows)
    assert [(r["doc_id"], r["shard_docs"]) for r in rows if not r["fits"]] == [(2, 1)]
    shards = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = odd_docs(spark).union(odd_docs(spark).withColumn("doc_id", F.lit(None).cast("long")))
    sharding.write_shards(docs, f"{tmp_path}/shards", 8)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    sizes = back.groupBy("shard_bits").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["b"] <= 8 or r["n"] == 1 for r in sizes)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "system", "Be <|im_end|> kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é" * 5), (None, None, None, "alone"), (2, 0, "system", "nobody")]
    views = {(r["conv_id"], r["speaker"]): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))).collect()}
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = views[1, "ann"]
    assert ann["rendered"] == "<|im_start|>system\nBe < |im_end|> kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\n" + "é" * 5 + "<|im_end|>\n"
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|im_end|>", "é" * 5 + "<|im_end|>"]
    turns = spark.createDataFrame([(1, i, "ab"[i % 2], f"t{i}") for i in range(25)], "conv_id long, turn long, role string, text string")
    whole = {r["speaker"]: r["rendered"] for r in chat.rotate_perspectives(turns).collect()}
    parts = chat.rotate_perspectives(turns, part_turns=4).orderBy("speaker", "part").collect()
    for speaker, text in whole.items():
        mine = [r for r in parts if r["speaker"] == speaker]
        assert "".join(r["rendered"] for r in mine) == text
        assert all(text[r["offset"] :].startswith(r["rendered"]) for r in mine)


def test_imatch_against_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in queries.op5_imatch(spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for i, (d, text) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b, c = ([f[k : k + 16] for k in range(0, len(f), 16)] for f in (r["fingerprint"], r["edited_fingerprint"], rows[docs[(i + 1) % len(docs)][0]]["fingerprint"]))
        for other, near in ((b, r["near_edited"]), (c, r["near_next"])):
            told = [x == y for x, y in zip(a, other, strict=True) if {x, y} != {"0" * 16}]
            assert near == pytest.approx(sum(told) / len(told) if told else 1.0)


def chain(values, seed=42):
    """Spark's xxhash64 of several values: each hashed with the hash before it as the seed."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v) if abs(v) > 99 else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def plain_imatch(texts):
    """The fingerprints of texts as hexadecimal numbers, from the definition."""
    split = [set(re.split(r"[\s!-/:-@\[-`{-~]+", t.lower(), flags=re.ASCII)) for t in texts]
    df = Counter(t for terms in split for t in terms)
    least, most = max(2, -int(-imatch.LOW * len(texts) // 1)), max(2.0, imatch.HIGH * len(texts))
    member = {}
    for term, n in df.items():
        if term and least <= n <= most:
            member[term] = 0
            for j in range(imatch.SUBSETS):
                rate, draw = divmod(j, imatch.DRAWS)
                drawn = chain([term, 2 * rate + draw // 4]) >> 16 * (draw % 4) & 0xFFFF
                member[term] |= (drawn < 65536 * imatch.RATES[rate]) << j
    out = []
    for terms in split:
        kept = sorted(t for t in terms if t in member)
        whole = chain(sorted(terms))
        hashes = []
        for j in range(imatch.SUBSETS):
            h = 42
            for t in (t for t in kept if member[t] >> j & 1):
                h = xxhash.xxh64_intdigest(struct.pack("<q", member[t]), xxhash.xxh64_intdigest(t.encode(), h))
            hashes.append(0 if h == 42 else h)
        out.append("".join(f"{h:016x}" for h in (hashes if kept else [whole] * imatch.SUBSETS)))
    return out


def test_imatch_fingerprints_from_the_terms(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["fingerprint"] for r in queries.op5_imatch(spark, FOLDER).collect()}
    assert got == dict(zip([d for d, _ in docs], plain_imatch([t for _, t in docs]), strict=True))


def test_imatch_of_far_and_missing_ids(spark):
    """An outlying id, ids at both ends of a long, and rows without an id leave order and ranges as they should be."""
    ids = [-(1 << 63), (1 << 63) - 1, 10**15, *range(3000)]
    rows = [(i, f"text number{n % 700} of{n % 41} some{n % 13}") for n, i in enumerate(ids)] + [(None, f"none{n}") for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.compare_with_edits(docs).collect() if r["doc_id"] is not None}
    known = sorted((i, t) for i, t in rows if i is not None)
    for (i, text), (_, after) in zip(known, known[1:], strict=False):
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    placed = imatch.in_neighbourhoods(docs).groupBy("g").count().collect()
    assert len(placed) > 5 and max(r["count"] for r in placed) < 1500
    assert imatch.compare_with_edits(docs).count() == len(rows)


def test_imatch_of_odd_rows(spark):
    rows = imatch.compare_with_edits(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert imatch.compare_with_edits(odd_docs(spark).limit(0)).collect() == []
    (only,) = imatch.compare_with_edits(odd_docs(spark).filter("doc_id = 4")).collect()
    assert only["near_next"] == 1.0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert graph.components(edges.limit(0)).collect() == []


def test_pipeline_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    odd = spark.createDataFrame([(1, None, "en", "s", None), (2, "12 34", "en", "s", 5), (3, "", None, None, None)], docs.schema)
    assert corpus_pipeline.keep_known_languages(spark, odd, f"{DATA}/sf0.01").collect() == []
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, docs, f"{DATA}/sf0.01").columns == docs.columns
        assert stage(spark, docs, f"{DATA}/sf0.01").collect() == []
    copies = spark.createDataFrame([(1, "same text here", "en", "s", 14), (2, "same  text here", "en", "s", 15), (3, "other", "en", "s", 5)], docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.drop_exact_copies(spark, copies, f"{DATA}/sf0.01").collect()} == {2, 3}


def test_pipeline_against_brute_force(spark):
    """Exact and near copies by looking at all pairs; the packed tokens by the library."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = corpus_pipeline.keep_known_languages(spark, docs, FOLDER)
    clean = corpus_pipeline.drop_toxic(spark, known, FOLDER)
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t)
    exact = {}
    for d, t in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        exact.setdefault(bare(t), (d, t))
    unique = sorted(exact.values())
    _, component = plain_similar(unique)
    left = {d: t for d, t in unique if component[d] == d}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_stages_take_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for c in ("row", "__row", "fp", "node", "kept", "score", "lang_pred", "component_id", "root", "token"):
        docs = docs.withColumn(c, F.lit("clash"))
    for stage in (corpus_pipeline.keep_known_languages, corpus_pipeline.drop_toxic, corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and 0 < kept.count() == kept.filter("__row = 'clash' AND row = 'clash'").count()


def test_stages_decide_on_each_row(spark):
    """Rows without an id, or that share one, are kept or dropped by their own texts."""
    long = lambda n: " ".join(f"{'abcdefgh'[n]}word{i}" for i in range(60))
    texts = lambda rows: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")

    copies = make([(None, "a b"), (None, "ab"), (None, "a  b"), (None, "b  a"), (None, "b a "), (None, "c"), (None, "c"), (7, "d"), (7, "e"), (8, "d ")])
    kept = texts(corpus_pipeline.drop_exact_copies(spark, copies, "").collect())
    assert [k for k in kept if "b" not in k[1]] == [(-1, "c"), (7, "e"), (8, "d ")]
    assert sorted(t.replace(" ", "") for _, t in kept if "b" in t) == ["ab", "ba"] and (-1, "a  b") in kept

    near = make([(None, long(0)), (None, long(0) + " end"), (None, long(1)), (7, long(2)), (7, long(2) + " end"), (7, long(3)), (8, long(3) + " end"), (None, long(3) + " stop")])
    kept = texts(corpus_pipeline.drop_near_copies(spark, near, "").collect())
    assert (7, long(3)) in kept and (-1, long(1)) in kept
    assert sorted(t[:1] for _, t in kept) == ["a", "b", "c", "d"]

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    no_id = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    whole = make([(None, "12 34")]).withColumn("lang", F.lit("en"))
    kept = corpus_pipeline.keep_known_languages(spark, no_id.select("doc_id", "text", "lang").union(whole), f"{DATA}/sf0.01")
    assert kept.filter("doc_id IS NULL").count() > 100 and kept.filter("text = '12 34'").count() == 0
