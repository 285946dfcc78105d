"""Vectors of items from sessions: skip-gram with negative sampling, trained in blocks of tokens and parts of pairs.

Tokens are dealt into blocks by hash; a cell is the pairs whose centre is in one block and whose context is in another. In
one exchange each cell of a diagonal (every block once on either side) trains on its own with the vectors of its two blocks,
and as many exchanges as there are blocks go through all cells. A cell of many pairs is trained in parts, each from the
same vectors; what a token's vector has moved by is averaged over the parts that moved it. The vectors stay a table: no
task has more than two blocks of them, the driver none. The pairs' rows are dealt and put in order once, as packed rows of
numbers; a pass moves only these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.checkpoints import checkpointed

# The reach of a context, negatives of a pair, how fast it learns, and how often a token of the vocabulary occurs.
DIMENSIONS, REACH, NEGATIVES, RATE = 16, 3, 5, 0.025
LEAST_COUNT = 2
#: Tokens of a block, pairs of a part, pairs of one numpy step, and how often small inputs are gone through.
BLOCK, PART, STEP = 50_000, 500_000, 256
PASSES, SLOTS = (5, 40), 40_000


def positions(plays: DataFrame, session: list[str], order: list[Column], item: str, strength: Column, parts: int | None = None) -> DataFrame:
    """Plays to session, item, weight and __at: strengths of zero go, repeats of an item in a row are one, the strongest.

    In so many parts by session, if told; token_pairs then moves nothing.
    """
    plays = plays.repartition(parts, *session) if parts else plays
    w = Window.partitionBy(*session).orderBy(*order)
    told = plays.withColumn("weight", strength.cast("double")).filter("weight <> 0").withColumn("__new", (~F.col(item).eqNullSafe(F.lag(item).over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    runs = told.withColumn("__at", F.sum("__new").over(w))
    return runs.groupBy(*session, "__at", item).agg(F.max("weight").alias("weight"), *[F.first(c).alias(c) for c in plays.columns if c not in (*session, item, "weight")])


def token_pairs(placed: DataFrame, session: list[str], item: str, also: str | None = None, reach: int = REACH) -> DataFrame:
    """center, context, label and rate of all pairs of tokens within reach in a session."""
    return pairs_of(meetings(placed, session, item, also, reach))


def meetings(placed: DataFrame, session: list[str], item: str, also: str | None = None, reach: int = REACH) -> DataFrame:
    """What pairs_of makes pairs of, an eighth of their rows or so: a row's tokens (i, a), its neighbour's (xi, xa), own if it is itself, label and rate.

    An item (and what else it has, as its artist) is pulled towards those around it and pushed from what was skipped among them:
    weights below zero are skips, at half their strength; they take no place. All is told by windows of a session, and a row meets its
    neighbours one row each, so that placed is gone through once and Spark compiles all of it (functions of arrays it would interpret).
    """
    played = F.col("weight") > 0
    item_token = F.concat(F.lit("i:"), F.col(item).cast("string"))
    also_token = F.concat(F.lit("a:"), F.nullif(F.col(also).cast("string"), F.lit(""))) if also else F.lit(None).cast("string")
    w = Window.partitionBy(*session).orderBy("__at")
    counted = placed.select(*session, "__at", "weight", item_token.alias("i"), also_token.alias("a"), played.alias("__played"), F.sum(played.cast("long")).over(w).alias("__n"))
    # a play knows those around it; a skip stands between the plays counted before it and the next ones, which the last play knows, or the first one
    each = F.struct("__n", "i", "a", "weight")
    alike = Window.partitionBy(*session, "__played").orderBy("__at")
    beside = [F.lag(each, -k).over(alike) for k in range(1 - reach, 0)] + [each] + [F.lag(each, -k).over(alike) for k in range(1, reach + 1)]
    around = counted.withColumn("__around", F.when(F.col("__played"), F.array(*beside)))
    last = F.last("__around", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first(F.when(F.col("__n") == 1, F.col("__around")), ignorenulls=True).over(Window.partitionBy(*session))
    known = around.withColumn("__first", first).withColumn("__around", F.coalesce(last, "__first")).filter("weight <> 0")
    met = known.select("__n", "i", "a", "weight", F.explode("__around").alias("x")).filter("x IS NOT NULL")

    n, weight, to, strength = F.col("__n"), F.col("weight"), F.col("x.__n"), F.col("x.weight")
    fade = lambda apart: (reach + 1 - apart) / reach
    play, own = weight > 0, (weight > 0) & (to == n)
    near, within = (to > n) & (to <= n + reach), to.between(n - reach + 1, n + reach)
    pulled = F.when(own, weight).when(near, F.sqrt(weight * strength) * fade(to - n))
    apart = F.when(to <= n, n - to + 1).otherwise(to - n)
    pushed = F.when(within, 0.5 * -weight * F.sqrt(strength) * fade(apart))
    # of a skip only what comes first is pushed away; a row and itself make each pair once, others make it both ways
    return met.select(
        F.when(play, F.col("i")).otherwise(F.coalesce("i", "a")).alias("i"), F.when(play, F.col("a")).alias("a"), F.col("x.i").alias("xi"), F.col("x.a").alias("xa"), own.alias("own"),
        F.when(play, pulled).otherwise(pushed).alias("rate"), F.when(play, 1.0).otherwise(0.0).alias("label"),
    ).filter("rate > 0")


def pairs_of(met: DataFrame) -> DataFrame:
    """center, context, label and rate of meetings."""
    both = [(x, y) for x in ("i", "a") for y in ("xi", "xa")]
    ways = [F.struct(F.col(x).alias("center"), F.col(y).alias("context")) for x, y in both] + [F.struct(F.when(~F.col("own"), F.col(y)).alias("center"), F.col(x).alias("context")) for x, y in both]
    return met.select("rate", "label", F.explode(F.array(*ways)).alias("p")).select("p.center", "p.context", "rate", "label").filter("center <> context")


def _chooser(negatives_of):
    """Random numbers from 0 to 1 to rows, as searchsorted finds them in the running sums: mostly by a table of where it would begin and end."""
    last, total = len(negatives_of) - 1, negatives_of[-1]
    places = 1 << min(18, (16 * len(negatives_of)).bit_length())
    found = lambda at: np.searchsorted(negatives_of, at, side="right").clip(max=last)
    begins = found(np.arange(places + 1) / places * total)
    sure = begins[1:] == begins[:-1]

    def choose(numbers: np.ndarray) -> np.ndarray:
        place = (numbers * places).astype(np.int64)
        out, open_ = begins.take(place), ~sure.take(place)
        out[open_] = found(numbers[open_] * total)
        return out

    return choose


def train(center, context, label, rate, inputs, outputs, negatives_of, rng, negatives: int = NEGATIVES, step: int = STEP) -> None:
    """Moves inputs and outputs (rows of vectors) for pairs given by rows, a step of pairs at a time.

    Within a step all gradients are taken where it began and then added up. negatives_of: the running sums of the rows' weights as negatives.
    """
    size, choose = inputs.shape[1], _chooser(negatives_of)
    flat = np.arange(max(len(inputs), len(outputs)) * size).reshape(-1, size)  # where a row lies in one dimension
    flat_in, flat_out = inputs.reshape(-1), outputs.reshape(-1)
    for first in range(0, len(center), 64 * step):
        some = slice(first, first + 64 * step)
        t, y, a = context[some, None], label[some, None], rate[some, None]
        drawn = choose(rng.random((len(t), negatives)))
        all_targets = np.concatenate([t, drawn], axis=1)
        all_wanted = np.concatenate([y, np.zeros(drawn.shape)], axis=1)
        all_used = np.concatenate([np.ones(t.shape, bool), (drawn != t) & (y > 0)], axis=1)
        for begin in range(0, len(t), step):
            part = slice(begin, begin + step)
            c, targets = center[some][part], all_targets[part].reshape(-1)
            x, o = inputs.take(c, axis=0), outputs.take(targets, axis=0).reshape(len(c), -1, size)
            pull = (all_wanted[part] - 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", x, o)))) * a[part] * all_used[part]
            # in one dimension, which numpy adds up several times as fast, in the same order
            np.add.at(flat_out, flat.take(targets, axis=0).reshape(-1), (pull[:, :, None] * x[:, None, :]).reshape(-1))
            np.add.at(flat_in, flat.take(c, axis=0).reshape(-1), np.einsum("nk,nkd->nd", pull, o).reshape(-1))


_MOVED = "side int, block int, token string, n long, vector array<double>, times long"
_PACKED = "a int, b int, part int, nth int, center binary, context binary, label binary, rate binary"
_KINDS = {"center": np.int32, "context": np.int32, "label": np.float64, "rate": np.float64}
#: Pairs of one packed row.
_CHUNK = 100_000


def _sides(rows: pa.Table) -> list[pa.Table]:
    return [rows.filter(pc.equal(rows["side"], k)).sort_by("token") for k in (0, 1)]


def _pack(pairs: pa.Table, tokens: pa.Table) -> pa.Table:
    """One part of a cell, once for all passes: its pairs of known tokens in order, as numbers of the tokens in their blocks."""
    sides = _sides(tokens)
    nth: list[int] = []
    columns: dict[str, list[bytes]] = {c: [] for c in _KINDS}
    if len(pairs) and all(map(len, sides)):
        rows = [pc.index_in(pairs[c], value_set=s["token"].combine_chunks()) for c, s in zip(("center", "context"), sides, strict=True)]
        known = np.logical_and(*[np.array(r.is_valid()) for r in rows])
        at = [np.array(r.fill_null(0))[known] for r in rows]
        label, own = np.array(pairs["label"])[known], np.array(pairs["rate"])[known]
        order = np.lexsort((own, label, at[1], at[0]))  # rows of tokens are in the tokens' order
        for begin in range(0, max(1, len(order)), _CHUNK):
            chunk = order[begin : begin + _CHUNK]
            nth.append(len(nth))
            for (c, kind), values in zip(_KINDS.items(), (*at, label, own), strict=True):
                columns[c].append(values[chunk].astype(kind).tobytes())
    key = {c: pa.array([pairs[c][0].as_py()] * len(nth), pa.int32()) for c in ("a", "b", "part")} if nth else dict.fromkeys(("a", "b", "part"), pa.array([], pa.int32()))
    return pa.table(key | {"nth": pa.array(nth, pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in columns.items()})


def _cell(seed: int, epoch: int, epochs: int, passes: int, size: int, rate: float):
    """Trains one part of a cell: its packed pairs and the vectors of its two blocks to those that moved."""

    def run(packed: pa.Table, vectors: pa.Table) -> pa.Table:
        sides = _sides(vectors)
        if not len(packed) or not all(map(len, sides)):
            return vectors.slice(0, 0).select(["side", "block", "token", "n", "vector"]).append_column("times", pa.array([], pa.int64()))
        held = [np.array(s["vector"].combine_chunks().flatten()).reshape(len(s), size).copy() for s in sides]
        packed = packed.sort_by("nth")
        *at, label, own = [np.concatenate([np.frombuffer(x, kind) for x in packed[c].to_pylist()]) for c, kind in _KINDS.items()]
        at = [a.astype(np.int64) for a in at]
        chances = np.cumsum(np.array(sides[1]["n"]).astype(float) ** 0.75)
        part, block = packed["part"][0].as_py(), [s["block"][0].as_py() for s in sides]
        for i in range(passes):
            rng = np.random.default_rng([seed, epoch + i, part, *block])
            order = rng.permutation(len(label))
            fade = rate * np.maximum(1e-4, 1 - (epoch + i + np.arange(len(label)) / max(1, len(label))) / epochs)
            train(at[0][order], at[1][order], label[order], own[order] * fade, *held, chances, rng)
        out = []
        for side, (rows_, vector, used) in enumerate(zip(sides, held, at, strict=True)):
            times = np.bincount(used, minlength=len(rows_)) if side == 0 else np.full(len(rows_), max(1, len(label)))
            moved = pa.ListArray.from_arrays(pa.array(np.arange(len(rows_) + 1) * size, pa.int32()), pa.array(vector.reshape(-1)))
            out.append(rows_.select(["side", "block", "token", "n"]).append_column("vector", moved).append_column("times", pa.array(times, pa.int64())))
        return pa.concat_tables(out)

    return run


def _met(left: DataFrame, right: DataFrame, key: list[str], groups: int, run, schema: str) -> DataFrame:
    """run over the cogroups, dealt so that Spark doesn't put many of them into one task for their few bytes."""
    n = min(10_000, 2 * groups) if groups > 1 else 1
    return left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key)).applyInArrow(run, schema)


def item_vectors(pairs: DataFrame, counts: DataFrame, size: int = DIMENSIONS, seed: int = 42, epochs: int | None = None, rate: float = RATE, block: int = BLOCK, part: int = PART) -> DataFrame:
    """token and its vector of unit length, less what all have in common.

    pairs: center, context, label (1 together, 0 apart), rate; counts: token and n, those that have vectors (see
    operators.ranking.vocabulary). One block and one part are trained in a single task, all passes at once; else each pass is as many
    exchanges as there are blocks. The same input gives the same vectors, however its rows are dealt.
    """
    tokens, n_pairs = counts.count(), pairs.count()
    blocks, parts = max(1, -(-tokens // block)), max(1, -(-n_pairs // (part * max(1, -(-tokens // block)) ** 2)))
    least, most = PASSES
    epochs = epochs or int(np.clip(-(-SLOTS // max(1, n_pairs // (2 * REACH))), least, most))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: (F.pmod(F.xxhash64("token", d, F.lit(seed)), F.lit(1 << 30)) / (1 << 30) - 0.5) / size)
    rows = counts.select("token", F.col("n").cast("long").alias("n"), of("token").alias("block"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    vectors = checkpointed(rows.select("side", "block", "token", "n", F.when(F.col("side") == 0, start).otherwise(F.array_repeat(F.lit(0.0), size)).alias("vector")))
    dealt = pairs.select("center", "context", F.col("label").cast("double").alias("label"), F.col("rate").cast("double").alias("rate"))
    dealt = dealt.withColumn("a", of("center")).withColumn("b", of("context")).withColumn("part", F.pmod(F.xxhash64("center", "context", "rate"), F.lit(parts)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = rows.select("side", "block", "token", every(blocks).alias("__other")).withColumn("part", every(parts))
    names = names.select("side", "token", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("__other")).alias("a"), F.when(F.col("side") == 1, F.col("block")).otherwise(F.col("__other")).alias("b"), "part")
    packed = checkpointed(_met(dealt, names, ["a", "b", "part"], blocks * blocks * parts, _pack, _PACKED))
    alone = blocks == parts == 1
    for epoch in range(0, epochs, epochs if alone else 1):
        for shift in range(blocks):
            here = packed.filter(F.pmod(F.col("b") - F.col("a"), F.lit(blocks)) == shift)
            cell = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks)))
            beside = vectors.withColumn("a", cell).withColumn("part", every(parts))
            run = _cell(seed, epoch, epochs, epochs if alone else 1, size, rate)
            moved = _met(here, beside, ["a", "part"], blocks * parts, run, _MOVED).filter("times > 0")
            if alone:
                new = moved.select("side", "block", "token", F.col("vector").alias("__new"))
            else:
                # a sum for each dimension: a row for each would be sixteen times as many, for every token in every part
                sums = [(F.sum(F.col("vector")[d] * F.col("times")) / F.sum("times")).alias(f"__{d}") for d in range(size)]
                new = moved.groupBy("side", "block", "token").agg(*sums).select("side", "block", "token", F.array(*[f"__{d}" for d in range(size)]).alias("__new"))
            vectors = checkpointed(vectors.join(new, ["side", "block", "token"], "left").select("side", "block", "token", "n", F.coalesce("__new", "vector").alias("vector")))
    inputs = vectors.filter("side = 0")
    each = inputs.select("token", F.posexplode("vector").alias("d", "x"))
    centred = each.join(F.broadcast(each.groupBy("d").agg(F.avg("x").alias("m"))), "d").select("token", "d", (F.col("x") - F.col("m")).alias("x"))
    gathered = centred.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("all"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return gathered.select("token", F.transform("all", lambda s: F.when(F.col("length") > 0, s["x"] / F.col("length")).otherwise(0.0)).alias("vector"))
