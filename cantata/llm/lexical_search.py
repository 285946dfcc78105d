"""Ranked lexical search over an index whose documents are ordered by recursive graph bisection.

The bisection is fitted on a bounded sample (``SAMPLED`` documents, by hash, and their ``VOCABULARY`` most frequent terms):
the documents of a node are halved, and pairs swapped between the halves as long as that lowers the cost of the gaps
in the posting lists (for a term of a documents on a side of n, a * log2(n / (a + 1))). All documents, of the sample or not,
then go down the tree, to the side where they cost less. A leaf is a cluster; one of many bytes is dealt into
shards of about ``SHARD_BYTES``, by hash, so that copies or a hot cluster fill many shards and no task.

A shard is one row of the index: its documents' ids in the order that the bisection gives, its terms, of each the largest
impact (the bound), and the postings as (place, impact). A query's bound in a shard is the sum of its terms' weights times
these. Shards are visited by bound: a first few for every query, then more, then all that are left; before each step those
are left out whose bound is below the score of the tenth document found so far, which can't come in any more. Equal bounds are visited, since
a tie is decided by doc_id. Queries go in blocks of bounded size; what reaches the driver are the block's terms and thresholds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed, remove, row_key, shared_path
from cantata.llm.pretokens import small_slices

SAMPLED, VOCABULARY, DEPTH, SWEEPS = 4096, 1 << 14, 7, 12
SHARD_BYTES = 2 << 20
#: Shards that each query visits in the first step and in the second; the third takes all that are left.
STEPS = (4, 32)
TOP = 10
#: Characters of a block of queries.
BLOCK_CHARS = 4 << 20
#: Bytes of visits that are broadcast at most.
BROADCAST_BYTES = 32 << 20
_NO_ID = -(1 << 63)  # stands for a null id, before all others
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str) -> list[str]:
    """The terms of a text in order: runs of ASCII letters, digits and all beyond ASCII; only A-Z lower-cased."""
    return _TERM.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def _cost(a: np.ndarray, n: int) -> np.ndarray:
    return a * np.log2(max(n, 1) / (a + 1.0))


@dataclass
class Bisection:
    """The tree: what a term adds to the case for the right side at each inner node, and where a node is cut."""

    vocabulary: list[str]
    weights: np.ndarray  # inner nodes x terms
    cuts: np.ndarray  # inner nodes

    @property
    def depth(self) -> int:
        return int(math.log2(len(self.cuts) + 1))

    def place(self, codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and last score of n documents, whose distinct known terms are codes, doc saying whose."""
        node, score = np.zeros(n, np.int64), np.zeros(n)
        for _ in range(self.depth):
            score = np.bincount(doc, weights=self.weights[node[doc], codes], minlength=n)
            node = 2 * node + 1 + (score > self.cuts[node])
        return node - len(self.cuts), score


def bisect(docs: list[np.ndarray], vocabulary: list[str], depth: int = DEPTH, sweeps: int = SWEEPS) -> Bisection:
    """Recursive graph bisection of a sample: docs are arrays of distinct codes of terms."""
    weights, cuts = np.zeros(((1 << depth) - 1, len(vocabulary)), np.float32), np.zeros((1 << depth) - 1)
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.concatenate(docs) if docs else np.zeros(0, np.int64)

    def edges(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of these documents, and whose they are (by place in part)."""
        owner = np.repeat(np.arange(len(part)), lengths[part])
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(lengths[part]) - lengths[part], lengths[part])
        return codes[np.repeat(starts[part], lengths[part]) + inside], owner

    def split(node: int, part: np.ndarray) -> None:
        if node >= len(cuts):
            return
        of, owner = edges(part)
        right = np.zeros(len(part), bool)
        right[len(part) // 2 :] = True
        count = lambda side: np.bincount(of[side[owner]], minlength=len(vocabulary)).astype(float)
        a, b, n_a, n_b = count(~right), count(right), len(part) // 2, len(part) - len(part) // 2
        for _ in range(sweeps):
            now = _cost(a, n_a) + _cost(b, n_b)
            to_right, to_left = now - _cost(np.maximum(a - 1, 0), n_a) - _cost(b + 1, n_b), now - _cost(a + 1, n_a) - _cost(np.maximum(b - 1, 0), n_b)
            gain = np.bincount(owner, weights=np.where(right[owner], to_left[of], to_right[of]), minlength=len(part))
            left_first, right_first = (np.flatnonzero(x)[np.argsort(-gain[x], kind="stable")] for x in (~right, right))
            pairs = min(len(left_first), len(right_first))
            worth = int((gain[left_first[:pairs]] + gain[right_first[:pairs]] > 1e-9).sum())  # a falling sum: a prefix
            if not worth:
                break
            right[left_first[:worth]], right[right_first[:worth]] = True, False
            a, b = count(~right), count(right)
        weights[node] = _cost(a + 1, n_a) + _cost(b, n_b) - _cost(a, n_a) - _cost(b + 1, n_b)
        score = np.bincount(owner, weights=weights[node][of], minlength=len(part))
        cuts[node] = np.median(score) if len(part) else 0.0
        goes = score > cuts[node]
        split(2 * node + 1, part[~goes])
        split(2 * node + 2, part[goes])

    split(0, np.arange(len(docs)))
    return Bisection(vocabulary, weights, cuts)


def fit(docs: DataFrame) -> Bisection:
    """(doc_id, text) to the tree, from SAMPLED documents or so, drawn by hash."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    sample = docs.filter(F.pmod(row_key(), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def of_each(batches):
        for batch in batches:
            for (texts,) in small_slices(batch, column=0):
                yield pa.RecordBatch.from_arrays([pa.array([sorted(set(terms(t))) for t in texts], pa.list_(pa.string()))], names=["terms"])

    split = checkpointed(sample.select("text").mapInArrow(of_each, "terms array<string>").withColumn("row", F.monotonically_increasing_id()))
    each = split.select("row", F.explode("terms").alias("term"))
    known = each.groupBy("term").count().filter("count > 1").orderBy(F.desc("count"), "term").limit(VOCABULARY)
    vocabulary = sorted(r["term"] for r in known.collect())
    in_it = split.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "term string, code int")
    coded = each.join(F.broadcast(in_it), "term").groupBy("row").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    drawn = [np.array(r["codes"], dtype=np.int64) for r in coded.orderBy(F.xxhash64("row"), "row").collect()]  # of the sample
    return bisect(drawn, vocabulary)


def _coded(counted: list[Counter], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    of, lengths = np.fromiter(map(codes.get, chain.from_iterable(counted), repeat(-1)), np.int64), [len(c) for c in counted]
    doc = np.repeat(np.arange(len(counted)), lengths)
    return of[of >= 0], doc[of >= 0]


@dataclass
class Index:
    path: str
    documents: int  # that have a term
    words: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


_SHARD = "shard string, ids array<long>, terms array<string>, bounds array<int>, ends array<int>, places binary, impacts binary"


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Write the index of all of docs' rows to the shared folder. Rows without a term are in no shard."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    shipped = spark.sparkContext.broadcast(fit(texts))  # of fixed size

    def place(batches, emit):
        model = shipped.value
        codes = {w: i for i, w in enumerate(model.vocabulary)}
        for batch in batches:
            for ids, slice_ in small_slices(batch, chars=4_000_000):
                counted = [Counter(terms(t)) for t in slice_]
                cluster, score = model.place(*_coded(counted, codes), len(counted))
                yield emit(ids, slice_, counted, cluster, score)

    def sizes(batches):
        def emit(_, __, counted, cluster, score):
            n = np.array([sum(c.values()) for c in counted], dtype=np.int64)
            amount = np.array([8 * len(c) + len("".join(c)) for c in counted], dtype=np.int64)
            by = lambda x: pa.array(np.bincount(cluster, weights=x, minlength=len(present)).astype(np.int64))
            present = np.arange(cluster.max(initial=-1) + 1)
            return pa.RecordBatch.from_arrays([pa.array(present), by(n > 0), by(n), by(amount)], names=["cluster", "documents", "words", "bytes"])

        return place(batches, emit)

    total = texts.mapInArrow(sizes, "cluster long, documents long, words long, bytes long").groupBy("cluster")
    found = total.agg(*[F.sum(c).alias(c) for c in ("documents", "words", "bytes")]).collect()  # a row for each cluster
    n_docs, n_words = sum(r["documents"] for r in found), sum(r["words"] for r in found)
    parts = {r["cluster"]: max(1, -(-r["bytes"] // shard_bytes)) for r in found}

    def forward(batches):
        import xxhash

        def emit(ids, texts_, counted, cluster, score):
            here = [i for i, c in enumerate(counted) if c]
            own = [xxhash.xxh64_intdigest(texts_[i].encode(), (ids[i] or 0) & 0xFFFFFFFF) for i in here]
            rows = [
                [f"{c}.{h % parts[c]}" for c, h in zip(cluster[here].tolist(), own, strict=True)],
                [ids[i] for i in here],
                [float(score[i]) for i in here],
                [list(counted[i]) for i in here],
                [list(counted[i].values()) for i in here],
            ]
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["shard", "doc_id", "score", "terms", "tfs"])

        return place(batches, emit)

    def invert(table: pa.Table) -> pa.Table:
        by_place = pc.sort_indices(table, sort_keys=[("score", "ascending"), ("doc_id", "ascending")], null_placement="at_start")
        table = table.take(by_place).combine_chunks()
        lengths = pc.list_value_length(table["terms"]).to_numpy()
        words, tf = pc.list_flatten(table["terms"]).combine_chunks().dictionary_encode(), pc.list_flatten(table["tfs"]).to_numpy().astype(np.int64)
        place_of = np.repeat(np.arange(len(lengths)), lengths)
        n = np.bincount(place_of, weights=tf, minlength=len(lengths)).astype(np.int64)
        m = np.array([25 + 75 * int(x) * n_docs // n_words for x in n], dtype=np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place_of])
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(words.dictionary)))
        bounds = np.maximum.reduceat(impact[order], np.concatenate([[0], ends[:-1]]))
        longs = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table(
            {
                "shard": table["shard"].slice(0, 1),
                "ids": pa.ListArray.from_arrays([0, len(table)], table["doc_id"].combine_chunks()),
                "terms": longs(words.dictionary, pa.string()),
                "bounds": longs(bounds.astype(np.int32), pa.int32()),
                "ends": longs(ends.astype(np.int32), pa.int32()),
                "places": pa.array([place_of[order].astype("<u4").tobytes()], pa.binary()),
                "impacts": pa.array([impact[order].astype("<u4").tobytes()], pa.binary()),
            }
        )

    path = shared_path(spark, "lexical-index")
    rows = texts.mapInArrow(forward, "shard string, doc_id long, score double, terms array<string>, tfs array<int>")
    rows.groupBy("shard").applyInArrow(invert, _SHARD).write.parquet(path)
    return Index(path, n_docs, n_words)


def _query_blocks(queries: DataFrame, id_col: str, text_col: str):
    """Lists of (id, text) of bounded size (or of one query); the queries with a text, each row on its own."""
    asked = queries.select(F.col(id_col).alias("q"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    block, chars = [], 0
    for r in asked.orderBy("q", "text").toLocalIterator():
        if block and chars + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r["q"], r["text"]))
        chars += len(r["text"])
    if block:
        yield block


def _bounds(index: Index, table: DataFrame, codes: dict[str, int]) -> DataFrame:
    """shard, code, bound, df of the block's terms in every shard; the postings aren't read."""
    shipped = table.sparkSession.sparkContext.broadcast(sorted(codes))  # a block's terms, in the order of their codes

    def run(batches):
        asked = pa.array(shipped.value, pa.string())
        for batch in batches:
            shards, terms_of, bounds, ends = batch.columns
            for i in range(batch.num_rows):
                at = pc.index_in(asked, value_set=terms_of[i].values)
                code = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                at = at.drop_null().to_numpy()
                df = np.diff(ends[i].values.to_numpy(), prepend=0)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shards[i].as_py()] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(bounds[i].values.to_numpy()[at], pa.int32()), pa.array(df, pa.int32())],
                    names=["shard", "code", "bound", "df"],
                )

    return table.select("shard", "terms", "bounds", "ends").mapInArrow(run, "shard string, code int, bound int, df int")


def _visited(table: DataFrame, visits: DataFrame, wanted: list[dict[int, int]], names: list[str], top: int) -> DataFrame:
    """(shard, asked) to q, doc_id, score: the best of each visited shard for each of the queries that visit it."""
    shipped = table.sparkSession.sparkContext.broadcast((wanted, names))  # a block's queries and terms

    def run(batches):
        queries, words = shipped.value
        vocabulary = pa.array(words, pa.string())
        for batch in batches:
            ids_of, terms_of, ends_of, places_of, impacts_of, asked_of = batch.columns
            for i in range(batch.num_rows):
                ids, ends = pc.fill_null(ids_of[i].values, _NO_ID).to_numpy(), ends_of[i].values.to_numpy()
                places, impacts = np.frombuffer(places_of[i].as_buffer(), "<u4"), np.frombuffer(impacts_of[i].as_buffer(), "<u4")
                at = pc.fill_null(pc.index_in(vocabulary, value_set=terms_of[i].values), -1).to_numpy()
                out = ([], [], [])
                for q in asked_of[i].as_py():
                    total = np.zeros(len(ids), np.int64)
                    for code, weight in queries[q].items():
                        if (t := at[code]) >= 0:
                            span = slice(ends[t - 1] if t else 0, ends[t])
                            total[places[span]] += weight * impacts[span].astype(np.int64)
                    some = np.flatnonzero(total)
                    if len(some) > top:  # ties with the last one stay for the order by id
                        some = some[total[some] >= np.partition(total[some], -top)[-top]]
                    some = some[np.lexsort((ids[some], -total[some]))][:top]
                    for column, values in zip(out, ([q] * len(some), ids[some], total[some]), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([None if x == _NO_ID else x for x in out[1]], pa.int64()), pa.array(out[2], pa.int64())], names=["q", "doc_id", "score"])

    by_shard = checkpointed(visits.groupBy("shard").agg(F.collect_list("q").alias("asked")))
    size = by_shard.agg(F.coalesce(F.sum(F.size("asked") * 4 + 64), F.lit(0))).first()[0]
    rows = table.join(F.broadcast(by_shard) if size <= BROADCAST_BYTES else by_shard, "shard")
    return rows.select("ids", "terms", "ends", "places", "impacts", "asked").mapInArrow(run, "q int, doc_id long, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: Index, spark: SparkSession, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """item_id, rank, doc_id, score, shards (visited for the item): each query's best documents with a score above 0.

    Equal scores go by doc_id. Rows of docs that share an id, or have none (null is first), are documents of their own. A query
    row that is repeated is answered again; one without a known term, or null, has no rows. With nothing asked or nothing
    indexed the result is empty.
    """
    out, table = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, shards long"), index.table(spark)
    for block in _query_blocks(queries, id_col, text_col):
        asked = [Counter(terms(text)) for _, text in block]
        names = sorted({w for c in asked for w in c})
        codes = {w: i for i, w in enumerate(names)}
        bounds = checkpointed(_bounds(index, table, codes))
        n, weight = index.documents, np.zeros(len(names), np.int64)
        for r in bounds.groupBy("code").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
            weight[r["code"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
        wanted = [{codes[w]: k * int(weight[codes[w]]) for w, k in c.items() if weight[codes[w]]} for c in asked]
        shares = spark.createDataFrame([(q, c, w) for q, x in enumerate(wanted) for c, w in x.items()], "q int, code int, w long")
        # a block's terms; a shard's bounds are summed before they move
        reach = bounds.join(F.broadcast(shares), "code").groupBy("q", "shard").agg(F.sum(F.col("w") * F.col("bound")).alias("reach")).filter("reach > 0")
        reach = checkpointed(reach)
        left, found, seen = reach, None, [0] * len(block)
        for step in (*steps, None):
            order = Window.partitionBy("q").orderBy(F.desc("reach"), "shard")
            visits = left if step is None else left.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= step).drop("at")
            visits = checkpointed(visits)
            counts = {r["q"]: (r["count"], r["last"]) for r in visits.groupBy("q").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("reach", F.col("shard"))).alias("last")).collect()}
            if not counts:
                break
            seen = [s + counts.get(q, (0,))[0] for q, s in enumerate(seen)]
            new = _visited(table, visits.select("q", "shard"), wanted, names, top)
            found = checkpointed(_best(new if found is None else new.unionByName(found.drop("rank")), top))
            if step is not None:
                least = {r["q"]: r["score"] for r in found.filter(F.col("rank") == top).select("q", "score").collect()}
                limits = spark.createDataFrame([(q, least.get(q, 1)) for q in range(len(block))], "q int, least long")
                left = checkpointed(left.join(visits.select("q", "shard"), ["q", "shard"], "left_anti").join(F.broadcast(limits), "q").filter("reach >= least").select("q", "shard", "reach"))
        if found is not None:
            items = spark.createDataFrame([(q, block[q][0], seen[q]) for q in range(len(block))], "q int, item_id long, shards long")
            out = out.unionByName(found.join(F.broadcast(items), "q").select("item_id", "rank", "doc_id", "score", "shards"))
    return out


def drop(index: Index, spark: SparkSession) -> None:
    remove(spark, index.path)
