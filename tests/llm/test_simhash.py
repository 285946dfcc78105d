import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cantata.llm import simhash
from tests.differential import DATA


def plain_fingerprint(text, shingle=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=4):
    """fps: list of (doc_id, unsigned fingerprint), to component ids, by looking at all pairs."""
    h = np.array([f for _, f in fps], dtype=np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(h ^ h[i]) <= max_bits):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    assert {d: r["fp"] & (1 << 64) - 1 for d, r in got.items()} == dict(want)
    assert {d: r["component_id"] for d, r in got.items()} == plain_components(want)


def test_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40)
    fps = {int(b) for b in base} | {int(b) ^ int(sum(1 << int(x) for x in rng.choice(62, rng.integers(1, 6), replace=False))) for b in base for _ in range(30)}
    frame = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    for max_bits, partitions in ((4, (3,)), (7, (4,)), (4, (2, 3, 4))):
        rooted = simhash.connect(frame, max_bits, partitions).collect()
        groups = {}
        for r in rooted:
            groups.setdefault(r["root"], set()).add(r["fp"])
        plain = {}
        for f, c in plain_components([(f, f) for f in sorted(fps)], max_bits).items():
            plain.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t ", "c"), (4, "one two", "d"), (4, "one two", "d"), (None, "one two", "e"), (5, "ONE two", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash"))
    got = sorted((r["doc_id"] or 0, r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, False, 4), (1, True, 1), (2, True, 1), (3, True, 1), (4, False, 4), (4, False, 4), (5, False, 4)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_similarity_is_verified(spark):
    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["changed"] + words[151:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    found = simhash.near_duplicates(docs, 5, 12, (4,), min_similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3}


def shingle_set(text, shingle=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def plain_similar(rows, least=0.8):
    """rows: (doc_id, text), to the pairs of positions that are that similar and the component ids, by looking at all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((j, i))
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return pairs, {d: smallest[find(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, edits):
    """words with this many changed, far enough apart that each changes five shingles."""
    out = list(words)
    for k in rng.choice(len(words) // 6, edits, replace=False):
        out[int(k) * 6] = f"new{rng.integers(1 << 30)}"
    return out


def planted():
    """A text and copies of it at about 0.80 to 0.95, from 40 to 400 words, with a line that half the texts have."""
    rng, rows = np.random.default_rng(11), []
    line = "this very common line is a part of every second text here".split()
    for base in range(60):
        size = int(rng.choice([40, 50, 100, 200, 400]))
        words = [f"w{rng.integers(20000)}" for _ in range(size)] + line * (base % 2)
        rows.append(words)
        for similarity in (0.75, 0.8, 0.85, 0.9, 0.95):
            edits = round(size * (1 - similarity) / (1 + similarity) / 5)
            rows.append(edited(rng, words, edits) if edits else [*words, f"end{base}", f"x{similarity}"])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_all_similar_pairs_are_found(spark):
    rows = planted()
    pairs, want = plain_similar(rows)
    assert len(pairs) > 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, min_similarity=0.8).collect()}
    assert sum(found[rows[i][0]] == found[rows[j][0]] for i, j in pairs) == len(pairs)
    assert found == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(want.values())


def test_large_groups_are_found_whole(spark):
    rng, rows = np.random.default_rng(3), []
    for edits in (2, 5, 7):  # of one text: well above 0.8 to each other, about 0.8, and mostly below
        words = [f"g{edits}w{i}" for i in range(200)]
        rows += [" ".join(edited(rng, words, edits)) for _ in range(100)]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, min_similarity=0.8).collect()}
    assert found == plain_similar(rows)[1]


def test_equal_fingerprints_are_compared(spark):
    line = "one line that a page repeats over and over without end"
    body = lambda n: " ".join(f"p{n}w{i}" for i in range(60))
    near = body(3).replace("p3w30", "changed")
    rows = [(1, f"{(line + ' ') * 400}{body(1)}"), (2, f"{(line + ' ') * 400}{body(2)}"), (3, f"{(line + ' ') * 400}{body(3)}"), (4, f"{(line + ' ') * 400}{near}"), (5, f"{(line + ' ') * 300}{near}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs, 5, 7, (4,), min_similarity=0.8).collect()
    assert len({r["fp"] for r in found}) == 1
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3} == plain_similar(rows)[1]


def test_all_links_of_a_table(spark):
    """Every pair of 0.8 or more of sf0.01 ends in one group, and nothing else does."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    pairs, want = plain_similar(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, min_similarity=0.8).collect()}
    assert len(pairs) > 50 and found == want


def test_long_texts_have_sketches_of_a_part(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(9000)]
    rows = [(i, " ".join(edited(rng, words, e))) for i, e in enumerate([0, 10, 60, 120, 180, 220, 260, 300, 300, 240])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, min_similarity=0.8).collect()}
    assert found == plain_similar(rows)[1]
