"""All pairs of texts that share at least a given part of their distinct shingles, and what they connect.

Of two sets of that similarity, ordered alike, the first few shingles always have one in common (prefix filter). Any
order will do, so that no pair is missed; shingles common in a sample of the texts come last, which keeps the groups
small. Texts with the same set of shingles are one node.

A group is the nodes that show one shingle. Its head is the node that shows it first, that is, the one with the fewest
rarer shingles: of a family of edited copies the one nearest to what they were made from. First each node is compared
with the heads of its groups. Then links are looked for between what those ties leave apart, and only there: each node
that isn't tied to the head of a group is compared with that group. A sketch of each set is a part of that join's condition:
how many of its shingles are in each of 512 classes, of smaller sets only whether that is odd. What two sketches differ by is
never more than what the sets differ by, so that no similar pair is lost and hardly any other comes out of the join. Texts
decide on what is left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed
from cantata.llm.graph import components
from cantata.llm.pretokens import small_slices

#: Texts that are sampled for common shingles, and shingles that are taken for common: they set the order alone.
SAMPLED, COMMON = 4000, 50_000
#: Nodes of one group, and pairs of one node, that go to one place.
PART = 2000
#: Bits of the bitmap by which rows whose texts aren't needed are passed over (most of them).
_BITMAP = 1 << 23
#: Classes of a sketch; sets of up to _ODD shingles have its parities, those of _COUNTED and more its counts: similar ones share a kind.
_CLASSES, _COUNTED, _ODD = 512, 640, 800
_CHUNK = 1 << 18


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, in order and with repeats; a text of fewer words is one shingle."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # of bytes: only A-Z, and ASCII white space
    joined, total = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    if not words:
        return np.array([xxhash.xxh64_intdigest(b"", 42)], dtype=np.uint64)
    starts, ends, digest, parts = (ends - lengths)[:total], ends[min(shingle, len(words)) - 1 :], xxhash.xxh64_intdigest, []
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        parts.append(np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=min(_CHUNK, total - at)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _node(distinct: np.ndarray) -> int:
    """The digest of a sorted set of shingles, as a signed long."""
    import xxhash

    return xxhash.xxh64_intdigest(distinct.tobytes(), 7) - (1 << 63)


def sketch(distinct: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The parities of the classes as longs, and the counts (32767 at most, which brings no two nearer than they are)."""
    counts = np.bincount((distinct & np.uint64(_CLASSES - 1)).astype(np.int64), minlength=_CLASSES)
    odd = np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64) if len(distinct) <= _ODD else None
    return odd, np.minimum(counts, 32767).astype(np.int16) if len(distinct) >= _COUNTED else None


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles found most often in a sample, by hash, each with its place from the rarest (1) on."""

    def run(batches):
        for batch in batches:
            for (sampled,) in small_slices(batch, column=0):
                for text in sampled:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle)).view(np.int64))], names=["token"])

    part = min(1.0, SAMPLED / max(1, texts.count()))
    counts = texts.select("text").sample(part, seed=5).mapInArrow(run, "token long").groupBy("token").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "token").limit(COMMON).collect()  # two numbers each
    hashes = np.array([r["token"] for r in reversed(found)], dtype=np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return hashes[by_hash], by_hash + 1


def prefixes(docs: DataFrame, shingle: int, least: float, fingerprint) -> DataFrame:
    """(row, doc_id, text) to row, doc_id, fp, node, size, odd, counts, rare and common.

    The last two are the shingles of which a similar text always has one, in order; those before are the sketch.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches):
        common, places = shipped.value
        for batch in batches:
            for rows, ids, texts in small_slices(batch, column=2):
                fps, nodes, sizes, odds, counts, rare, often = [], [], [], [], [], [], []
                for text in texts:
                    h = shingle_hashes(text, shingle)
                    s = np.unique(h)
                    shown = len(s) - math.ceil(least * len(s) - 1e-9) + 1
                    odd, count = sketch(s)
                    place = np.zeros(len(s), np.int64)
                    if len(common):
                        found = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        place = np.where(common[found] == s, places[found], 0)
                    first = s[place == 0][:shown].view(np.int64)
                    last = s[place > 0][np.argsort(place[place > 0])][: shown - len(first)].view(np.int64)
                    fps.append(fingerprint(text, h))
                    nodes.append(_node(s))
                    sizes.append(len(s))
                    odds.append(odd)
                    counts.append(count)
                    rare.append(first)
                    often.append(last)
                longs = pa.list_(pa.int64())
                columns = [pa.array(x, pa.int64()) for x in (rows, ids, fps, nodes)] + [pa.array(sizes, pa.int32())]
                columns += [pa.array(odds, longs), pa.array(counts, pa.list_(pa.int16()))] + [pa.array(x, longs) for x in (rare, often)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "fp", "node", "size", "odd", "counts", "rare", "common"])

    schema = "row long, doc_id long, fp long, node long, size int, odd array<long>, counts array<short>, rare array<long>, common array<long>"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, text) of all rows that wanted (row) has, and of few others."""
    place = F.pmod("row", F.lit(_BITMAP))
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(row, {_BITMAP}) % 64 AS INT))")).alias("bits"))
    bitmap = np.zeros(_BITMAP // 64, dtype=np.int64)
    for r in words.collect():  # 131072 at most
        bitmap[r["word"]] = r["bits"]
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) % _BITMAP
            found = shipped.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(found.astype(bool)))

    return docs.select("row", "text").mapInArrow(run, "row long, text string")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of pairs (u, v) of nodes, those whose texts share at least this part of their shingles.

    A node of many pairs has its text in as many places as they fill.
    """
    pairs = checkpointed(pairs)
    degrees = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ends = degrees.join(nodes.select("node", F.col("first.row").alias("row")), "node")
    ends = checkpointed(ends.select("node", "row", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    texts = checkpointed(_texts(docs, ends).join(ends, "row").dropDuplicates(["node"]))
    for side, other in (("u", "v"), ("v", "u")):
        parts = ends.select(F.col("node").alias(side), F.col("parts").alias(f"parts_{side}"))
        pairs = pairs.join(parts, side).withColumn(f"part_{side}", F.pmod(F.xxhash64(other), f"parts_{side}").cast("int")).drop(f"parts_{side}")
    for side in ("u", "v"):
        of = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{side}"))
        pairs = pairs.join(of, [side, f"part_{side}"])

    def run(batches):
        for batch in batches:
            for us, vs, first, second in small_slices(batch, column=2):
                kept, known = [], {}
                for u, v, a, b in zip(us, vs, first, second, strict=True):
                    for key, text in ((u, a), (v, b)):
                        if key not in known:
                            if len(known) >= 64:
                                known.clear()
                            known[key] = np.unique(shingle_hashes(text, shingle))
                    x, y = known.get(u), known[v]
                    x = np.unique(shingle_hashes(a, shingle)) if x is None else x
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(both + 1e-9 >= least * (len(x) + len(y) - both))
                at = np.flatnonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)[at]), pa.array(np.array(vs, np.int64)[at])], names=["u", "v"])

    return checkpointed(pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long"))


def _with_token(often: DataFrame, rare: DataFrame, keep: Column, **aggregates: Column) -> DataFrame:
    """Rows (token, ...) of common and of rare tokens with these aggregates of their token's rows, where keep holds of them.

    Common tokens, which may be in any part of all texts, are no more than COMMON: theirs are broadcast. Both sides of
    the rare ones' join read one exchange; nothing may prune just one of them.
    """
    named = [c.alias(name) for name, c in aggregates.items()]
    rare = rare.repartition("token")
    of_often, of_rare = (x.groupBy("token").agg(*named).filter(keep) for x in (often, rare))
    common = often.join(F.broadcast(of_often), "token").withColumn("is_common", F.lit(True))
    return common.unionByName(rare.join(of_rare.hint("shuffle_hash"), "token").withColumn("is_common", F.lit(False)))


def in_groups(nodes: DataFrame) -> DataFrame:
    """token, is_common, node, size, at (the token's place in the prefix), n and head of the token's group, where n > 1."""
    rare = nodes.select("node", "size", F.posexplode("rare").alias("at", "token"))
    often = nodes.select("node", "size", F.size("rare").alias("before"), F.posexplode("common").alias("at", "token"))
    often = often.withColumn("at", F.col("at") + F.col("before")).drop("before")
    return checkpointed(_with_token(often, rare, F.col("n") > 1, n=F.count(F.lit(1)), head=F.min(F.struct("at", "size", "node"))))


def _may_be_similar(size_a: Column, at_a: Column, size_b: Column, at_b: Column, least: float) -> Column:
    """By their sizes, and by what is left of either from a shared token on."""
    enough = F.least(size_a - at_a, size_b - at_b) >= least / (1 + least) * (size_a + size_b) - 1e-9
    return enough & (F.least(size_a, size_b) >= least * F.greatest(size_a, size_b) - 1e-9)


def ties(grouped: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes with the heads of their groups, each once."""
    head = F.col("head")
    tied = grouped.filter((F.col("node") != head["node"]) & _may_be_similar(F.col("size"), F.col("at"), head["size"], head["at"], least))
    return tied.select(F.least("node", "head.node").alias("u"), F.greatest("node", "head.node").alias("v")).distinct()


def _sketches_agree(least: float) -> str:
    """SQL for i and p: their sketches differ by no more than similar sets can."""
    odd = "aggregate(zip_with(i.odd, p.odd, (a, b) -> bit_count(a ^ b)), 0, (sum, x) -> sum + x)"
    counts = "aggregate(zip_with(i.counts, p.counts, (a, b) -> abs(a - b)), 0, (sum, x) -> sum + x)"
    return f"IF(greatest(i.size, p.size) <= {_ODD}, {odd}, {counts}) <= {(1 - least) / (1 + least)} * (i.size + p.size) + 1e-9"


def candidates(grouped: DataFrame, nodes: DataFrame, tied: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of differently rooted nodes that share a token of their prefixes and may be similar, each once.

    tied has node and root of the nodes whose root is another.
    """
    rooted = checkpointed(grouped.select("token", "is_common", "node", "size", "at", "n").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")))
    often, rare = rooted.filter("is_common").drop("is_common"), rooted.filter("NOT is_common").drop("is_common")
    apart = _with_token(often, rare, F.col("a") != F.col("b"), a=F.min("root"), b=F.max("root"), main=F.min_by("root", F.struct("at", "size", "node")))
    apart = checkpointed(apart.drop("a", "b", "is_common").join(nodes.select("node", "odd", "counts"), "node").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    index = apart.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("i")
    probes = apart.filter("root <> main").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).alias("p")
    i, p = (lambda c: F.col(f"i.{c}")), (lambda c: F.col(f"p.{c}"))
    fits = (i("root") != p("root")) & _may_be_similar(i("size"), i("at"), p("size"), p("at"), least) & F.expr(_sketches_agree(least))
    same = (i("token") == p("token")) & (i("part") == p("part"))
    return probes.join(index, same & fits).select(F.least(i("node"), p("node")).alias("u"), F.greatest(i("node"), p("node")).alias("v")).distinct()
