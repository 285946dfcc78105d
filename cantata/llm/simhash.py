"""SimHash near-duplicates by a generalised pigeonhole search.

The 64 bits are put into groups, correlated bits together. If the thresholds of m groups add up to max_bits - m + 1,
two fingerprints within max_bits differ in some group by no more than its threshold. The thresholds need not be equal,
and -1 leaves a group out: dynamic programming finds those with the least work, from the fingerprints' bits and from
how many share each group's value, for several m, of which the one with the least work is taken. Every fingerprint is then indexed by its
value in each group and probed with all values within the threshold; a pair is verified in the join itself and
taken in the first group that finds it, so only links come out, each once.

Equal fingerprints are one node, so copies are never paired with each other. Nor are the members of a large group
of near copies: first each is tied to a few heads of the buckets it is in, and the search then looks only for links
between what those ties leave apart.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm import similarity
from cantata.llm.common import checkpointed, id_and_text, row_key
from cantata.llm.graph import components
from cantata.llm.pretokens import small_slices
from cantata.llm.similarity import shingle_hashes

BITS = 64
_CHUNK = 1 << 16
#: What a probed row costs, in compared pairs.
ROW_COST = 10.0


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of a text as a signed 64-bit number."""
    return fingerprint_of(text, shingle_hashes(text, shingle))


def fingerprint_of(text: str, hashes: np.ndarray) -> int:
    """The SimHash of a text with these shingles."""
    if not text.encode("utf-8").split():
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a long) for each row; a null or blank text has 0."""

    def run(batches):
        for batch in batches:
            for ids, texts in small_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _together(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and of those that have bits i and j both set (64 x 64 sums, over all of them)."""

    def run(batches):
        sums = np.zeros((BITS, BITS))
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(sums.ravel())], names=["at", "n"])

    sums = np.zeros(BITS * BITS)
    for r in fps.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4096 numbers
        sums[r["at"]] = r["n"]
    return fps.count(), sums.reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, partitions: int) -> list[list[int]]:
    """The bits in groups of (nearly) equal size: each starts from the most correlated bit left and takes its likes."""
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    likeness = np.abs((together / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    left, groups = set(range(BITS)), []
    for g in range(partitions):
        size = (BITS - sum(map(len, groups)) + partitions - g - 1) // (partitions - g)
        first = max(sorted(left), key=lambda b: likeness[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: likeness[b, group].sum())
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    """The bits as a signed long."""
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))


def expected_pairs(differ: np.ndarray, same: float, most: int) -> list[float]:
    """Pairs within 0, 1, ... most bits of a group: as many as share its value, times what independent bits add."""
    within = np.zeros(most + 2)
    within[0] = 1.0
    for q in differ:
        within[1:] = within[1:] * (1 - q) + within[:-1] * q
        within[0] *= 1 - q
    return [same * within[: t + 1].sum() / max(within[0], 1e-30) for t in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of -1 (costs nothing) and up with this sum at the least cost; costs[g][t] for t >= 0."""
    best = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t in range(-1, len(cost)):
                new = (c + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if s + t not in nxt or new < nxt[s + t]:
                    nxt[s + t] = new
        best = nxt
    return best[total][1]


def plan(fps: DataFrame, max_bits: int, choices: tuple[int, ...]) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each group that is searched: of these numbers of groups, the one with the least work."""
    n, together = _together(fps)
    grouped = {m: group_bits(n, together, m) for m in choices}
    values = [F.struct(F.lit(m).alias("m"), F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("value")) for m, groups in grouped.items() for g, bits in enumerate(groups)]
    shared = fps.select(F.inline(F.array(*values))).groupBy("m", "g", "value").count().groupBy("m", "g").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("same"))
    same = {(r["m"], r["g"]): r["same"] for r in shared.collect()}  # one number a group
    p, best = np.diag(together) / max(1, n), None
    for m, groups in grouped.items():
        costs = []
        for g, bits in enumerate(groups):
            chance = n * (n - 1) / 2 * float(np.prod(p[bits] ** 2 + (1 - p[bits]) ** 2))
            pairs = expected_pairs(2 * p[bits] * (1 - p[bits]), max(same.get((m, g), 0.0), chance), max_bits)
            probes = np.cumsum([comb(len(bits), d) for d in range(max_bits + 1)])
            costs.append([float(pairs[t] + ROW_COST * n * probes[t]) for t in range(max_bits + 1)])
        thresholds = allocate(costs, max_bits - m + 1)
        work = sum(c[t] for c, t in zip(costs, thresholds, strict=True) if t >= 0)
        if best is None or work < best[0]:
            best = work, [(_mask(b), b, t) for b, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


def ties(fps: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links (u, v) of fingerprints to the heads of their buckets (equal values of a group), four at most for each."""
    at = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for g, m in enumerate(masks)])).alias("b")).select("fp", "b.*")
    mixed = F.xxhash64("fp")
    heads = F.array_distinct(F.array(F.min("fp"), F.max("fp"), F.min_by("fp", mixed), F.max_by("fp", mixed)))
    buckets = at.groupBy("g", "value").agg(heads.alias("heads")).filter(F.size("heads") > 1)
    near = F.filter("heads", lambda h: (h != F.col("fp")) & (F.bit_count(h.bitwiseXOR(F.col("fp"))) <= max_bits))
    return at.join(buckets, ["g", "value"]).select(F.col("fp").alias("u"), F.explode(near).alias("v")).distinct()


def links(nodes: DataFrame, searched: list[tuple[int, list[int], int]], max_bits: int) -> DataFrame:
    """Distinct fingerprints (fp, root) to all pairs u < v of other roots that differ in max_bits bits at most, each once.

    The join sorts, so that a bucket of many fingerprints spills instead of filling a task's memory.
    """
    index = probes = None
    for g, (mask, bits, threshold) in enumerate(searched):
        value = F.col("fp").bitwiseAND(F.lit(mask))
        changes = [_mask(list(c)) for d in range(threshold + 1) for c in combinations(bits, d)]
        at = nodes.select(F.lit(g).alias("g"), value.alias("value"), F.col("fp").alias("v"), F.col("root").alias("rv"))
        near = nodes.select(F.lit(g).alias("g"), value.alias("value"), F.col("fp").alias("u"), F.col("root").alias("ru"), F.explode(F.array(*map(F.lit, changes))).alias("change"))
        near = near.select("g", F.col("value").bitwiseXOR(F.col("change")).alias("value"), "u", "ru")
        index, probes = (at, near) if index is None else (index.union(at), probes.union(near))
    change = F.col("u").bitwiseXOR(F.col("v"))
    fits = (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & (F.bit_count(change) <= max_bits)
    for g, (mask, _, threshold) in enumerate(searched[:-1]):
        fits &= (F.col("p.g") <= g) | (F.bit_count(change.bitwiseAND(F.lit(mask))) > threshold)
    same = (F.col("p.g") == F.col("i.g")) & (F.col("p.value") == F.col("i.value"))
    return probes.alias("p").join(index.alias("i").hint("merge"), same & fits).select("u", "v")


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (fp, root) after the roots that edges (u, v) connect have become one."""
    of = lambda end: nodes.select(F.col("fp").alias(end), F.col("root").alias(f"r{end}"))
    joined = components(edges.join(of("u"), "u").join(of("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()).withColumnRenamed("root", "top")
    return checkpointed(nodes.join(joined, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("top", "root").alias("root")))


def connect(fps: DataFrame, max_bits: int, choices: tuple[int, ...]) -> DataFrame:
    """Distinct fingerprints (fp) to (fp, root): one root for those that links connect."""
    searched = plan(fps, max_bits, choices)
    nodes = fps.select("fp", F.col("fp").alias("root"))
    nodes = _rooted(nodes, ties(fps, [m for m, _, _ in searched], max_bits))
    return _rooted(nodes, links(nodes, searched, max_bits))


def connect_similar(nodes: DataFrame, docs: DataFrame, shingle: int, least: float, max_bits: int, choices: tuple[int, ...]) -> DataFrame:
    """Nodes (node, first, fp, size, odd, counts, rare, common) to (node, root), root being another: what links of similar nodes connect.

    The nodes of one fingerprint are compared with one of them, and fingerprints within max_bits with each other; what
    is similar, but farther apart in bits, has a rare shingle in common (see the module similarity). In both searches
    heads come first, and then what they leave apart.
    """
    fps = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("of")))
    searched = plan(fps.select("fp"), max_bits, choices)
    ends = lambda found: found.join(fps.select(F.col("fp").alias("u"), F.col("of").alias("a")), "u").join(fps.select(F.col("fp").alias("v"), F.col("of").alias("b")), "v")
    as_nodes = lambda found: ends(found).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    equal = nodes.select("node", "fp").join(fps, "fp").filter("node <> of").select(F.col("of").alias("u"), F.col("node").alias("v"))
    grouped = similarity.in_groups(nodes)
    near = as_nodes(ties(fps.select("fp"), [m for m, _, _ in searched], max_bits))
    strong = similarity.similar(equal.union(near).union(similarity.ties(grouped, least)).distinct(), nodes, docs, shingle, least)
    tied = components(strong)
    rooted = fps.join(tied, F.col("of") == F.col("node"), "left").select("fp", F.coalesce("root", "of").alias("root"))
    near = as_nodes(links(rooted, searched, max_bits))
    found = similarity.similar(near.union(similarity.candidates(grouped, nodes, tied, least)).distinct(), nodes, docs, shingle, least)
    return components(strong.union(found))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    max_bits: int = 4,
    partitions: tuple[int, ...] = (2, 3, 4),
    id_col: str = "doc_id",
    text_col: str = "text",
    min_similarity: float | None = None,
) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the smallest id of its connected fingerprints).

    partitions are the numbers of bit groups to choose from. With min_similarity not the bits decide, but the texts: all
    those that share at least that part of their distinct shingles are linked, whatever their fingerprints, and no
    others. row (see row_key) and component_row are added, the row of the component's smallest id.

    A null or blank text has fingerprint 0 and is linked like any other; repeated rows share a component. A null id
    is no component's smallest unless all its ids are null. An empty table gives an empty result. Each text is a whole
    in its task: some 100 bytes for each of its words.
    """
    if min_similarity is None:
        key, columns, found = "fp", ["doc_id", "fp"], ["component_id"]
        rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
        classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
        rooted = classes.join(connect(classes.select("fp"), max_bits, partitions), "fp")
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    else:
        key, columns, found = "node", ["doc_id", "fp", "row"], ["component_id", "component_row"]
        texts = id_and_text(docs, id_col, text_col).withColumn("row", row_key())
        rows = checkpointed(similarity.prefixes(texts, shingle, min_similarity, fingerprint_of))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        kept = ("size", "odd", "counts", "rare", "common")
        nodes = rows.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in kept])
        nodes = checkpointed(nodes)
        joined = connect_similar(nodes, texts, shingle, min_similarity, max_bits, partitions)
        rooted = nodes.select("node", "first", "n").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = rooted.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("component_row"))
    labels = checkpointed(rooted.join(named, "root").select(key, "n", *found))
    # a class with over a thousandth of all rows: there are fewer than 1000 of those, so they can be broadcast
    total = rows.count()
    hot = labels.filter(F.col("n") * 1000 > total).select(key, *[F.col(c).alias(f"hot_{c}") for c in found], F.lit(True).alias("is_hot"))
    marked = rows.select(*dict.fromkeys([*columns, key])).join(F.broadcast(hot), key, "left")
    done = marked.filter("is_hot").select(*columns, *[F.col(f"hot_{c}").alias(c) for c in found])
    rest = marked.filter("is_hot IS NULL").select(*dict.fromkeys([*columns, key])).join(labels.filter(F.col("n") * 1000 <= total), key)
    return done.unionByName(rest.select(*columns, *found))
