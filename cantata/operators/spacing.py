"""Peaks that stand apart: local maxima, gates by percentile, and a least distance kept in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.operators.checkpoints import checkpointed

#: Places of a chunk: a key's rows are worked on in chunks, whatever their number.
CHUNK = 1 << 16

# Of onsets the reach of a peak, that of its surroundings, how far it stands out, the least value and distance;
# of hits the same, with the least threshold and the share below the gate.
PEAK, AROUND, STANDS, LEAST, APART = 3, 16, 1.5, 0.002, 4
HIT_AROUND, HIT_STANDS, HIT_LEAST, QUIET, LOUD_SHARE = 40, 2.4, 0.15, 0.9, 0.1


def _neighbours(df: DataFrame, key: str, at: str, reach: int) -> tuple[DataFrame, Window]:
    """Rows in chunks of places, each also in the chunks that it is within reach of, and the window of a chunk."""
    low, high = (F.floor((F.col(at) + d) / CHUNK) for d in (-reach, reach))
    return df.withColumn("__chunk", F.explode(F.sequence(low, high))), Window.partitionBy(key, "__chunk").orderBy(at)


def _own(df: DataFrame, at: str) -> DataFrame:
    return df.filter(F.floor(F.col(at) / CHUNK) == F.col("__chunk")).drop("__chunk")


def onset_peaks(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Rows that are the greatest within PEAK places and stand out from the mean within AROUND ones; with ``local``.

    at counts a key's rows without gaps from 0. What is beyond a key's ends doesn't count.
    """
    rows, w = _neighbours(df, key, at, AROUND)
    told = rows.withColumn("__top", F.max(value).over(w.rowsBetween(-PEAK, PEAK))).withColumn("local", F.avg(value).over(w.rowsBetween(-AROUND, AROUND)))
    return _own(told, at).filter((F.col(value) >= LEAST) & (F.col(value) >= F.col("__top")) & (F.col(value) >= STANDS * F.col("local"))).drop("__top")


def hits(df: DataFrame, key: str, at: str, value: str, loudness: str, sure: float = 1.0) -> DataFrame:
    """Rows loud enough whose value is the greatest within PEAK places and above its threshold; with ``threshold``.

    Loud enough is a share of what nine tenths of the key's rows are below, which is found by counting, not by sorting a key
    in one place.
    """
    gates = quantile_row(df, key, loudness, QUIET).select(F.col(key).alias("__k"), F.greatest(F.lit(LEAST), F.col("quantile") * LOUD_SHARE).alias("__gate"))
    rows, w = _neighbours(df, key, at, HIT_AROUND)
    mean = F.avg(value).over(w.rowsBetween(-HIT_AROUND, HIT_AROUND))
    told = rows.withColumn("__top", F.max(value).over(w.rowsBetween(-PEAK, PEAK))).withColumn("threshold", F.greatest(F.lit(HIT_LEAST), mean * HIT_STANDS))
    own = _own(told, at).join(F.broadcast(gates) if gates.count() <= 100_000 else gates, F.col(key).eqNullSafe(F.col("__k")))
    keep = (F.col(loudness) >= F.col("__gate")) & (F.col(value) > F.col("threshold") * sure) & (F.col(value) >= F.col("__top")) & (F.col(at) >= 2)
    return own.filter(keep).drop("__top", "__gate", "__k")


def quantile_row(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key and ``quantile``: the value at place floor(n * share) of the key's sorted values, exactly.

    Distinct values are counted and looked up in turn, by running sums over a key's distinct values.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.groupBy(F.col(key).alias("__k")).agg(F.sum("__n").alias("__all"))
    upto = F.sum("__n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__upto", upto).join(total, F.col(key).eqNullSafe(F.col("__k")))
    return placed.filter(F.col("__upto") > F.least(F.floor(F.col("__all") * share), F.col("__all") - 1)).groupBy(key).agg(F.min(value).alias("quantile"))


def _kept(places: np.ndarray, free_from: int, gap: int) -> tuple[np.ndarray, int]:
    """Which of the sorted places stay, the first at free_from or later, and from where the next one may be."""
    keep = np.zeros(len(places), bool)
    i = int(np.searchsorted(places, free_from))
    while i < len(places):
        keep[i] = True
        free_from = int(places[i]) + gap
        i = int(np.searchsorted(places, free_from, side="left")) if i + 1 < len(places) and places[i + 1] < free_from else i + 1
    return keep, free_from


def spaced(df: DataFrame, key: str, at: str, gap: int = APART) -> DataFrame:
    """In order of at (a whole number, once a key), each row that is gap places or more after the last that stayed.

    A key is worked on in chunks: first every chunk says, for each place from which it may begin to keep rows, from where the
    next chunk may; these answers are put together along the key, a few numbers a chunk; then every chunk keeps its rows.
    """
    if not 1 <= gap <= CHUNK:
        raise ValueError("a gap from 1 to the places of a chunk")
    rows = checkpointed(df.withColumn("__chunk", F.floor(F.col(at) / CHUNK)))

    def told(table: pa.Table) -> pa.Table:
        begin = table["__chunk"][0].as_py() * CHUNK
        places = np.sort(table[at].to_numpy())
        ends = [max(0, _kept(places, begin + s, gap)[1] - begin - CHUNK) for s in range(gap)]
        return pa.table({key: table[key].slice(0, 1), "__chunk": table["__chunk"].slice(0, 1), "__ends": pa.array([ends], pa.list_(pa.int32()))})

    kind, names = df.schema[key].dataType.simpleString(), df.columns
    answers = rows.select(key, "__chunk", at).groupBy(key, "__chunk").applyInArrow(told, f"`{key}` {kind}, __chunk long, __ends array<int>")
    along = answers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__chunk", "__ends"))).alias("__all"))
    start = F.struct(F.lit(None).cast("long").alias("chunk"), F.lit(0).alias("free"), F.array().cast("array<struct<chunk: bigint, free: int>>").alias("begins"))

    def add(s: Column, c: Column) -> Column:
        free = F.when(s["chunk"] == c["__chunk"] - 1, s["free"]).otherwise(0)
        begins = F.concat(s["begins"], F.array(F.struct(c["__chunk"].alias("chunk"), free.cast("int").alias("free"))))
        return F.struct(c["__chunk"].alias("chunk"), F.get(c["__ends"], F.least(free, F.lit(gap - 1))).cast("int").alias("free"), begins.alias("begins"))

    begins = along.select(F.col(key).alias("__k"), F.inline(F.aggregate("__all", start, add)["begins"]).alias("__c", "__free"))
    joined = rows.join(begins, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__chunk") == F.col("__c"))).drop("__k", "__c")

    def kept(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        free = table["__chunk"][0].as_py() * CHUNK + table["__free"][0].as_py()
        return table.filter(pa.array(_kept(table[at].to_numpy(), free, gap)[0])).select(names)

    return joined.groupBy(key, "__chunk").applyInArrow(kept, T.StructType(df.schema.fields))
