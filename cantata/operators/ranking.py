"""Ranking: vocabularies, vectors, greedy diverse selection, logistic models with a prior, seeded sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.checkpoints import checkpointed


def vocabulary(tokens: DataFrame, token: str, least: int, size: int | None = None) -> DataFrame:
    """The tokens with at least `least` rows; only the most frequent ones if a size is told, ties by token."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), token).limit(size) if size is not None else counts


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def centroid(vectors: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """The mean vector of each key: dimensions are averaged on their own, then put back in order."""
    each = vectors.select(*keys, F.posexplode(vector).alias("__d", "__x")).groupBy(*keys, "__d").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    gathered = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__d", "__m"))).alias("__all"))
    return gathered.select(*keys, F.transform("__all", lambda s: s["__m"]).alias("centroid"))


def standardised(vectors: DataFrame, vector_id: str, vector: str, prior_weight: float = 4.0) -> DataFrame:
    """Each dimension less its mean, over a deviation that is drawn towards 1 by prior_weight rows: id, dim, z.

    The statistics are a row for each dimension, so they are broadcast.
    """
    each = vectors.select(vector_id, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = each.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n"))
    spread = F.sqrt((F.col("var") * F.col("n") + prior_weight) / (F.col("n") + prior_weight))
    scaled = stats.select("dim", "mean", spread.alias("spread"))
    return each.join(F.broadcast(scaled), "dim").select(vector_id, "dim", ((F.col("x") - F.col("mean")) / F.col("spread")).alias("z"))


def greedy_diverse(scored: DataFrame, group: str, item: str, member: str, score: str, n: int, gap: int) -> DataFrame:
    """In each group the best items one after another, no member twice within `gap` places unless nothing else is left.

    Sequential, so a task per group; only the candidates that may be reached are handed over: of each member its n best.
    """
    w = Window.partitionBy(group, member).orderBy(F.desc(score), item)
    reachable = scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    # the r-th best of a member can't be taken before place r; n members of the best firsts always suffice
    leaders = reachable.filter("__r = 1").withColumn("__l", F.row_number().over(w)).filter(F.col("__l") <= n).select(group, F.col(member))
    reachable = reachable.join(leaders, [group, member], "left_semi").select(group, item, member, score)

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        rest = df.sort_values([score, item], ascending=[False, True]).to_dict("records")
        out: list[dict] = []
        while rest and len(out) < n:
            recent = {r[member] for r in out[-gap:]} if gap else set()
            at = next((i for i, r in enumerate(rest) if r[member] not in recent), 0)
            out.append(rest.pop(at) | {"place": len(out) + 1})
        return pd.DataFrame(out, columns=[group, item, member, score, "place"])

    kinds = {f.name: f.dataType.simpleString() for f in reachable.schema}
    return reachable.groupBy(group).applyInPandas(pick, ", ".join(f"`{c}` {kinds[c]}" for c in (group, item, member, score)) + ", place int")


def logistic_with_prior(rows: DataFrame, group: str, features: list[str], label: str, weight: str, mean: float = 1.0, strength: float = 4.0, steps: int = 25) -> DataFrame:
    """For each group, logistic weights drawn towards `mean` (Newton steps): group, feature, coefficient.

    Rows are summed by their values once. Each step sums gradients and curvatures of all groups at once, before anything is
    shuffled, and solves a small system for each group; a group's rows are never together. Checkpoints cut the steps' lineage.
    """
    import numpy as np

    k = len(features)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    summed = rows.groupBy(F.col(group).alias("__group"), *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("__y"))
    grid = checkpointed(summed.agg(F.sum(F.col(weight).cast("double")).alias("__w")))
    x = [F.col(f"__x{i}") for i in range(k)]
    exponent = sum((F.col("__b")[i] * x[i] for i in range(k)), F.lit(0.0))
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), exponent))))
    sums = [F.sum(F.col("__w") * (chance - F.col("__y")) * x[i]).alias(f"__g{i}") for i in range(k)]
    sums += [F.sum(F.col("__w") * chance * (1 - chance) * x[i] * x[j]).alias(f"__h{i}_{j}") for i, j in upper]
    kind = rows.schema[group].dataType.simpleString()

    def solve(parts):
        for df in parts:
            b = np.array(df["__b"].tolist(), float).reshape(len(df), k)
            gradient = df[[f"__g{i}" for i in range(k)]].to_numpy(float) + strength * (b - mean)
            curve = np.zeros((len(df), k, k))
            for i, j in upper:
                curve[:, i, j] = curve[:, j, i] = df[f"__h{i}_{j}"].to_numpy(float)
            step = np.linalg.solve(curve + strength * np.eye(k), gradient[:, :, None])[:, :, 0]
            yield pd.DataFrame({"__key": df["__key"], "__b": list(b - step), "__step": np.abs(step).max(axis=1)})

    found = grid.select(F.col("__group").alias("__key")).distinct().withColumn("__b", F.array(*[F.lit(float(mean))] * k))
    for _ in range(steps):
        system = grid.join(found, F.col("__group").eqNullSafe(F.col("__key"))).groupBy("__key", "__b").agg(*sums)
        solved = checkpointed(system.mapInPandas(solve, f"__key {kind}, __b array<double>, __step double"))
        found, moved = solved.select("__key", "__b"), solved.agg(F.max("__step")).first()[0]
        if moved is None or moved < 1e-9:
            break
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("f"), F.col("__b").alias("b"))).alias("p")
    return found.select(F.col("__key").alias(group), named).select(group, F.col("p.f").alias("feature"), F.col("p.b").alias("coefficient"))


def thompson(counts: DataFrame, arm: str, wins: str, losses: str, seed: int) -> DataFrame:
    """arm and a draw from Beta(1 + wins, 1 + losses), the same for the same seed and arm wherever it runs."""

    @F.pandas_udf("double")
    def draw(arms: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        return pd.Series([np.random.default_rng([seed, zlib.crc32(str(k).encode())]).beta(1 + x, 1 + y) for k, x, y in zip(arms, a, b, strict=True)])

    return counts.select(arm, draw(F.col(arm).cast("string"), wins, losses).alias("draw"))


def power_weights(counts: DataFrame, key: str, n: str, exponent: float = 0.75) -> DataFrame:
    """Sampling weight n ** exponent and each key's share of their sum."""
    weighted = counts.withColumn("weight", F.pow(F.col(n).cast("double"), F.lit(exponent)))
    total = weighted.agg(F.sum("weight").alias("__t"))  # one row
    return weighted.join(F.broadcast(total)).select(key, n, "weight", (F.col("weight") / F.col("__t")).alias("share"))


def blocks(asked: DataFrame, asked_id: str, rows: DataFrame, row_id: str, of_asked: int = 4000, of_rows: int = 10_000) -> tuple[DataFrame, DataFrame, int]:
    """A stated set of queries and all rows, a block of either at a time: each block of queries (__a) meets each block of rows (__b) in one of so many cells."""
    parts = lambda df, size: max(1, -(-df.count() // size))
    m, n = parts(asked, of_asked), parts(rows, of_rows)
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("__a", deal(asked_id, m)).withColumn("__b", every(n))
    return left, rows.withColumn("__b", deal(row_id, n)).withColumn("__a", every(m)), m * n


def _vectors(column: pa.ChunkedArray) -> list:
    """Whole vectors in doubles; None for what is null or has a null."""
    return [None if v is None or None in v else np.array(v, float) for v in column.to_pylist()]


def _stacked(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: where they are, and the matrix of them."""
    at: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None:
            at.setdefault(len(v), []).append(i)
    return {size: (np.array(i), np.array([vectors[j] for j in i]).reshape(len(i), size)) for size, i in at.items()}


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as dot gives them: added one dimension after another."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _rounded(x: np.ndarray) -> np.ndarray:
    """Halves go away from zero, as in Spark's round."""
    whole = np.floor(np.abs(x))
    return np.sign(x) * (whole + (np.abs(x) - whole >= 0.5))


def rounded_cosines(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """round(cosine * scale) of all rows of a with all of b, NaN where a length is zero.

    Products of matrices add up in an order of their own: what lies that near to a half is worked out again in order.
    """
    aa, bb = _in_order(a, a), _in_order(b, b)
    with np.errstate(all="ignore"):
        x = (a / np.sqrt(aa)[:, None]) @ (b / np.sqrt(bb)[:, None]).T * scale
        known = np.multiply.outer(aa, bb) > 0
        unsure = known & (np.abs(np.abs(x) % 1 - 0.5) < 1e-14 * scale * max(64, a.shape[1]))
        for i in np.flatnonzero(unsure.any(axis=1)):
            j = np.flatnonzero(unsure[i])
            x[i, j] = _in_order(np.broadcast_to(a[i], (len(j), a.shape[1])), b[j]) / np.sqrt(aa[i] * bb[j]) * scale
        return np.where(known, _rounded(x), np.nan)


def nearest(asked: DataFrame, asked_id: str, rows: DataFrame, row_id: str, vector: str, k: int, scale: int = 10_000, **sizes: int) -> DataFrame:
    """asked_id, row_id and sim, the cosine in parts of scale: each query's k nearest rows but its own, ties by id, unknown cosines last.

    Either side has an id and the vector. Cells (see blocks) are products of matrices, and hand on k rows of a query: no vector
    leaves its cell and no pair is a row before. Every pair is compared, so the work grows with queries times rows.
    """
    side = lambda df, c: df.select(F.col(c).alias("__id"), F.col(vector).alias("__v")).filter("__id IS NOT NULL")
    left, right, cells = blocks(side(asked, asked_id), "__id", side(rows, row_id), "__id", **sizes)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, asked_id), (rows, row_id))]

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("__id")
        ids, n = found["__id"].combine_chunks(), len(found)
        near, far = _stacked(_vectors(queries["__v"])), _stacked(_vectors(found["__v"]))
        code = pc.fill_null(pc.index_in(queries["__id"].combine_chunks(), value_set=ids.unique()), -1).to_numpy(zero_copy_only=False)
        own = pc.index_in(ids, value_set=ids.unique()).to_numpy(zero_copy_only=False)
        size_of = np.full(len(queries), -1)
        for size, (at, _) in near.items():
            size_of[at] = size
        asked_at, found_at, sims = [], [], []
        for size in np.unique(size_of):
            at = np.flatnonzero(size_of == size)
            for begin in range(0, len(at), 256):
                some = at[begin : begin + 256]
                sim = np.full((len(some), n), np.nan)
                if size in near and size in far:
                    sim[:, far[size][0]] = rounded_cosines(near[size][1][begin : begin + 256], far[size][1], scale)
                order = np.where(np.isnan(sim), -scale - 2.0, sim) * n - np.arange(n)  # greatest first; of equal ones the lowest id
                order[code[some][:, None] == own[None, :]] = -np.inf
                best = np.argpartition(order, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), order.shape)
                i, j = np.repeat(np.arange(len(some)), best.shape[1]), best.ravel()
                kept = order[i, j] > -np.inf
                asked_at.append(some[i[kept]])
                found_at.append(j[kept])
                sims.append(sim[i[kept], j[kept]])
        asked_at, found_at, sims = (np.concatenate(x) if x else np.array([], int) for x in (asked_at, found_at, sims))
        told = pa.array(sims, pa.float64(), from_pandas=True).cast(pa.int64())
        return pa.table({asked_id: queries["__id"].take(pa.array(asked_at, pa.int64())), row_id: found["__id"].take(pa.array(found_at, pa.int64())), "sim": told})

    met = left.repartition(cells, "__a", "__b").groupBy("__a", "__b").cogroup(right.repartition(cells, "__a", "__b").groupBy("__a", "__b"))
    each = met.applyInArrow(meet, f"`{asked_id}` {kinds[0]}, `{row_id}` {kinds[1]}, sim long")
    best = Window.partitionBy(asked_id).orderBy(F.desc("sim"), row_id)
    return each.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= k).drop("__rn")
