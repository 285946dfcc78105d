"""Shards of bounded size by extendible hashing.

A document's bucket is a prefix of the bits of its id's hash. All documents start in the bucket of no bits; only
a bucket over the byte limit is split, on one bit more. The directory is found from sums per prefix, a round of
``BITS`` bits at a time: a round's prefixes of full length, its cells, are summed once, cells make buckets, and each
cell is told its shard. Documents look their cell up; those whose cell is still too large go to the next round. Rows
that no bit of the id parts (null or repeated ids) are split on by the bits of a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed

DEPTH = 60
BITS = 16


def _bits(text: Column) -> Column:
    """The first 60 bits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_bits(id_col: str) -> Column:
    """The first 60 bits of the MD5 of the id as text, as a number."""
    return _bits(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def _drop_low(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits.cast("int"))


def _round(active: DataFrame, base: int, top: int, last: bool, max_bytes: int) -> DataFrame:
    """Documents (stem, h, n_bytes) of buckets of base bits that are too large (or the whole) to their cells' shards.

    stem, cell, depth, prefix, shard_bytes, shard_docs; what is too large at top bits is left out, unless it's the last.
    """
    cells = active.groupBy("stem", _drop_low(F.col("h"), F.lit(DEPTH - top)).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    at = cells.select("stem", "cell", "b", "n", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
    at = checkpointed(at.withColumn("prefix", _drop_low(F.col("cell"), F.lit(top) - F.col("depth"))))
    fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | ((F.col("depth") == top) & F.lit(last))
    buckets = at.groupBy("stem", "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).filter(fits)
    # of a cell's prefixes that fit, the shortest is its shard
    found = at.join(buckets, ["stem", "depth", "prefix"]).groupBy("stem", "cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
    return checkpointed(found.select("stem", "cell", "s.*"))


def _place(rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows (h, own, n_bytes, ...) with shard, depth, shard_bytes, shard_docs for each."""
    tops = [*range(BITS, DEPTH, BITS), DEPTH]
    active, done = rows.withColumn("stem", F.lit("")), None
    for own in (False, True):
        for base, top in zip([0, *tops], tops, strict=False):
            shards = _round(active, base, top, own and top == DEPTH, max_bytes)
            # a first round has 65536 cells at most
            of = F.broadcast(shards) if base == 0 and not own else shards
            looked = active.withColumn("cell", _drop_low(F.col("h"), F.lit(DEPTH - top))).join(of, ["stem", "cell"], "left")
            bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
            placed = looked.filter("depth IS NOT NULL").withColumn("shard", F.concat("stem", bits)).withColumn("depth", F.col("depth") + (DEPTH if own else 0))
            placed = placed.drop("stem", "cell", "prefix", "h", "own")
            done = placed if done is None else done.unionByName(placed)
            active = checkpointed(looked.filter("depth IS NULL").select(*active.columns))
            if active.isEmpty():
                return done
        active = active.withColumn("stem", F.lpad(F.bin("h"), DEPTH, "0")).withColumn("h", F.col("own"))
    return done


def assign_shards(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, fits.

    ``shard`` is the bucket's bits ('' if all documents fit into one). A null text has no bytes. One document over the
    limit gets a shard of its own with fits = false. Rows that share an id (null is one) and are over the limit together
    are parted by bits of their own after the id's 60. An empty table gives an empty result.
    """
    return _assigned(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")), max_bytes)


def _assigned(rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows (doc_id, n_bytes, ...) with shard, depth, shard_bytes, shard_docs, fits; written once, so that each keeps its own bits."""
    own = _bits(F.monotonically_increasing_id().cast("string"))
    rows = checkpointed(rows.withColumn("h", hash_bits("doc_id")).withColumn("own", own))
    at = _place(rows, max_bytes).withColumn("fits", F.col("shard_bytes") <= max_bytes)
    first = [c for c in rows.columns if c not in ("h", "own")]
    return at.select(*first, "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", "fits")


def write_shards(docs: DataFrame, path: str, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs under path, a folder for each shard (``shard_bits=b...``); none exceeds max_bytes but for single documents."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), whole)
    placed = _assigned(rows, max_bytes).select("__row.*", F.concat(F.lit("b"), "shard").alias("shard_bits"))
    placed.repartition("shard_bits").write.partitionBy("shard_bits").mode("errorifexists").parquet(path)
