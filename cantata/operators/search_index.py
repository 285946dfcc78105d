"""A kept trigram index: posting lists in partitions by gram, written once, added to by deltas, read by partition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.operators.parts import spread

#: Partitions of the index, and documents of one posting list and letters of their texts; a gram of more has several lists.
BUCKETS, LIST, LETTERS = 64, 4096, 4_000_000


def grams_of(phrase: str) -> list[str]:
    low = phrase.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def bucket_of(gram: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(gram.encode()) % buckets


def _lists(ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The posting lists of some documents: characters as places in their alphabet, grams as numbers, with the document as the last digit."""
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[codes] = True
    letters, place = np.flatnonzero(used), np.cumsum(used) - 1
    n, size = len(texts), max(1, len(letters))
    if n > 1 and size**3 * n >= 1 << 63:  # many scripts at once
        for half in (slice(0, n // 2), slice(n // 2, n)):
            yield from _lists(ids[half], texts[half])
        return
    doc = np.repeat(np.arange(n), [len(t) for t in texts])
    c = place[codes]
    inside = doc[2:] == doc[:-2]
    grams = (c[:-2] * size + c[1:-1]) * size + c[2:]
    keys = np.sort(grams[inside] * n + doc[2:][inside])
    keys = keys[np.diff(keys, prepend=-1) != 0]
    gram, at = np.divmod(keys, n)
    begins = np.flatnonzero(np.diff(gram, prepend=-1) != 0)
    first = gram[begins]
    spelled = letters[np.stack([first // size**2, first // size % size, first % size], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(keys)), pa.int32()), pa.array(ids[at], pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)], pa.string()), lists], ["gram", "ids"])


def _postings(docs: DataFrame, doc_id: str, text: Column, version: int, buckets: int) -> DataFrame:
    """gram, ids, version and bucket; a document has each of its grams once.

    A task makes lists of LIST documents, or LETTERS of text, at a time: they are what is moved, not a row for each document's
    gram, and texts are gone through once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, letters = [], [], 0
        for batch in batches:
            for i, low in zip(batch["id"].to_pylist(), batch["low"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(low)
                letters += len(low)
                if len(ids) >= LIST or letters >= LETTERS:
                    yield from _lists(np.array(ids, np.int64), texts)
                    ids, texts, letters = [], [], 0
        if ids:
            yield from _lists(np.array(ids, np.int64), texts)

    low = F.lower(F.coalesce(text.cast("string"), F.lit(""))).alias("low")
    rows = spread(docs).select(F.col(doc_id).cast("long").alias("id"), low).filter("id IS NOT NULL")
    return rows.mapInArrow(run, "gram string, ids array<long>").select("gram", "ids", F.lit(version).alias("version"), (F.crc32("gram") % buckets).cast("int").alias("bucket"))


def write_index(docs: DataFrame, doc_id: str, text: Column, path: str, buckets: int = BUCKETS) -> None:
    """The index of a table as version 0: a folder a bucket."""
    _postings(docs, doc_id, text, 0, buckets).repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([], "id long, version int").write.parquet(f"{path}/gone")


def add_delta(changed: DataFrame, doc_id: str, text: Column, gone: DataFrame, path: str, version: int, buckets: int = BUCKETS) -> None:
    """Documents that are new or changed, and ids of those that are gone, as the next version.

    What is no longer true is written first: a reader in between misses a changed document and never finds an old text.
    """
    old = gone.select(F.col(doc_id).cast("long").alias("id")).unionByName(changed.select(F.col(doc_id).cast("long").alias("id"))).distinct()
    old.select("id", F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/gone")
    _postings(changed, doc_id, text, version, buckets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, phrase: str, buckets: int = BUCKETS) -> DataFrame:
    """Ids of documents that have all of the phrase's grams, by the buckets of these alone."""
    grams = grams_of(phrase)
    if not grams:
        raise ValueError("a phrase of three characters or more")
    index = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(sorted({bucket_of(g, buckets) for g in grams})) & F.col("gram").isin(grams))
    found = index.select("version", F.explode("ids").alias("id")).groupBy("id", "version").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    last = spark.read.parquet(f"{path}/gone").groupBy("id").agg(F.max("version").alias("__gone"))
    return found.join(last, "id", "left").filter(F.col("__gone").isNull() | (F.col("version") >= F.col("__gone"))).select("id")


def search(docs: DataFrame, doc_id: str, text: Column, path: str, phrase: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of docs, as they are now, whose text has the phrase, whatever its case; shorter phrases than three look at every text."""
    has = F.contains(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(phrase.lower()))
    if len(phrase) < 3:
        return docs.filter(has)
    found = candidates(docs.sparkSession, path, phrase, buckets).toDF("__found")
    return docs.join(found, F.col(doc_id).cast("long") == F.col("__found"), "left_semi").filter(has)
