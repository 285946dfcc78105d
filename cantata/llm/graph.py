"""Connected components of edges between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed

#: A round over fewer edges than would fill all tasks uses fewer.
EDGES_A_TASK = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) in either direction, both non-null, to (node, root): each node but its component's smallest.

    Loops and repeated edges do no harm; nodes without an edge are not listed. The rounds grow with the logarithm
    of the number of nodes; each ends in the shared checkpoint folder.
    """
    stars = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = checkpointed(stars)
    before = _state(stars)
    while before[0]:
        tasks = -(-before[0] // EDGES_A_TASK)
        stars = checkpointed(_small_star(_large_star(stars.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
