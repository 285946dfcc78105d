"""A listener's preferences learnt one outcome at a time, and when to train anew."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cantata.functions.text import lookup_text
from cantata.operators.mixing import hashed_features

# The learner's step, pull towards zero, start of the squares and bounds; what a day leaves, of 90 at most.
STEP, PULL, START, BOUND, STRONGEST = 0.18, 0.001, 0.01, 8.0, 4.0
DAILY, MOST_DAYS, DAY = 0.98, 90, 86400


def preference_features(track: dict[str, Column], before: dict[str, Column], hour: Column, dimensions: int = 4096) -> Column:
    """Hashed features, an array of (index, sign), of a track (title, artist, album, genre, seconds) after another (artist, genre).

    A track has up to three genres, parted by comma, semicolon or slash; hour: of the day, told in quarters of it.
    """
    text = lambda c: F.substring(lookup_text(c), 1, 160)
    genres = F.slice(F.filter(F.transform(F.split(F.coalesce(track["genre"], F.lit("")), "[,;/]"), text), lambda g: g != ""), 1, 3)
    texts = [text(track[f]).alias(f) for f in ("title", "artist", "album")] + [text(before[f]).alias(f"last_{f}") for f in ("artist", "genre")]
    once = F.array(F.struct(*texts, F.array_distinct(genres).alias("genres"), hour.alias("hour"), track["seconds"].alias("seconds")))
    # a token is made of texts that are worked out once, and hashed once
    return hashed_features(F.flatten(F.transform(once, _tokens)), dimensions)


def _tokens(of: Column) -> Column:
    title, artist, album, last_artist, last_genre, genres, hour, seconds = (of[f] for f in ("title", "artist", "album", "last_artist", "last_genre", "genres", "hour", "seconds"))
    quarter = F.concat(F.lit("time:"), F.floor(hour / 6).cast("string"))
    each = lambda prefix: F.transform(genres, lambda g: F.concat(prefix, g))
    known = artist != ""

    def one(when: Column, *parts: str | Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))).otherwise(F.array().cast("array<string>"))

    both, moved = known & (last_artist != ""), (F.size(genres) > 0) & (last_genre != "")
    # fixed values: the tokens, whose hashes are the features
    return F.concat(
        one(known, "artist:", artist),
        one(known & (album != ""), "album:", artist, "|", album),
        one(title != "", "song:", artist, "|", title),
        each(F.lit("genre:")),
        one(known, quarter, "|artist:", artist),
        each(F.concat(quarter, F.lit("|genre:"))),
        one(both, "transition:", last_artist, "|", artist),
        F.when(last_genre != "", each(F.concat(F.lit("transition:"), last_genre, F.lit("|")))).otherwise(F.array().cast("array<string>")),
        one(both, "flow:", F.when(artist == last_artist, "same-artist").otherwise("new-artist")),
        one(moved, "flow:", F.when(F.array_contains(genres, last_genre), "same-genre").otherwise("new-genre")),
        one(seconds > 0, "duration:", F.least(F.lit(5), F.floor(seconds / 90)).cast("string")),
    )


class Preferences:
    """Logistic weights of one listener with AdaGrad's squares; 64 KiB however long the history."""

    def __init__(self, dimensions: int, saved: tuple | None = None):
        weights, squares, self.updated, self.seen = saved or (None, None, None, 0)
        self.weights = np.zeros(dimensions) if weights is None else np.frombuffer(weights).copy()
        self.squares = np.zeros(dimensions) if squares is None else np.frombuffer(squares).copy()

    def saved(self) -> tuple:
        return self.weights.tobytes(), self.squares.tobytes(), self.updated, self.seen

    def meet(self, index: np.ndarray, sign: np.ndarray, reward: float, weight: float, at: float) -> float:
        """The chance of a reward as known before, then learns from it: a weight of 0 or none, or no feature, teaches nothing."""
        summed: dict[int, float] = {}
        for i, s in zip(index.tolist(), sign.tolist(), strict=True):
            summed[i] = summed.get(i, 0.0) + s
        known = sorted(summed)
        places, value = np.array(known, np.int64), np.array([summed[i] for i in known], float)
        value = value / (math.sqrt(value @ value) or 1.0)
        held = self.weights[places]
        chance = self._chance(held, value)
        if known and math.isfinite(reward) and math.isfinite(weight) and weight > 0 and math.isfinite(at):
            self._learn(places, value, min(max(reward, 0.0), 1.0), min(weight, STRONGEST), at, held, chance)
        return chance

    @staticmethod
    def _chance(held: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-min(max(float(held @ value), -20.0), 20.0))))

    def _learn(self, places: np.ndarray, value: np.ndarray, target: float, strength: float, at: float, held: np.ndarray, chance: float) -> None:
        days = 0 if self.updated is None else int((at - self.updated) // DAY)
        if days > 0:
            self.weights *= DAILY ** min(MOST_DAYS, days)
            self.squares *= DAILY ** min(MOST_DAYS, days)
            held = self.weights[places]
            chance = self._chance(held, value)
        slope = (chance - target) * strength * value + PULL * held
        squares = self.squares[places] + slope * slope
        self.squares[places] = squares
        self.weights[places] = np.minimum(np.maximum(held - STEP * slope / np.sqrt(squares + START), -BOUND), BOUND)
        self.seen, self.updated = self.seen + 1, at if self.updated is None else max(at, self.updated)


_ARRIVING = ["__index", "__sign", "__reward", "__weight", "__seconds"]


def _arriving(outcomes: DataFrame, who: str, at: str, item: str, features: Column, reward: Column, weight: Column) -> DataFrame:
    unknown = F.lit(float("nan"))
    number = lambda c: F.coalesce(c.cast("double"), unknown)
    none = F.array().cast("array<int>")
    arrays = F.coalesce(F.col("__features.index"), none), F.coalesce(F.col("__features.sign"), none)  # of a column, so that features are made once
    columns = [*arrays, number(reward), number(weight), number(F.unix_micros(F.col(at).cast("timestamp")) / 1e6)]
    return outcomes.withColumn("__features", features).select(who, item, *[c.alias(n) for c, n in zip(columns, _ARRIVING, strict=True)])


def _schema(outcomes: DataFrame, who: str, item: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in outcomes.schema}
    return f"`{who}` {kinds[who]}, `{item}` {kinds[item]}, preference double, observations long"


def learn_preferences(outcomes: DataFrame, who: str, at: str, item: str, features: Column, reward: Column, weight: Column, dimensions: int = 4096) -> DataFrame:
    """who, item, preference and observations: for each outcome the chance of a reward by what came before, and from how many.

    Each learns from the one before, so a listener's outcomes are one sequence; they are sorted by time and then item, and go
    through a batch at a time with one model in memory. An outcome without a time, weight, reward or feature is only judged.
    Rows without a listener are one listener's.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(who).cast("string")), F.lit(""))
    parts = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as told: few bytes may still be much work
    placed = _arriving(outcomes.repartition(parts, name), who, at, item, features, reward, weight)  # features are made where they are used, not moved
    sorted_ = placed.withColumn("__who", name).sortWithinPartitions("__who", "__seconds", item)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, model = None, None
        for batch in batches:
            met = []
            for name, *row in batch[["__who", *_ARRIVING]].itertuples(index=False):
                if name != current:
                    current, model = name, Preferences(dimensions)
                seen = model.seen
                met.append((model.meet(*row), seen))
            yield batch[[who, item]].assign(preference=[m[0] for m in met], observations=[m[1] for m in met])

    return sorted_.mapInPandas(run, _schema(outcomes, who, item))


def learn_preferences_stream(outcomes: DataFrame, who: str, at: str, item: str, features: Column, reward: Column, weight: Column, dimensions: int = 4096) -> DataFrame:
    """learn_preferences on a stream: a listener's model is the state, and outcomes are taken in order of time within a trigger."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = Preferences(dimensions, state.get if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["__seconds", item], kind="stable")
        met = []
        for row in rows[_ARRIVING].itertuples(index=False):
            seen = model.seen
            met.append((model.meet(*row), seen))
        state.update(model.saved())
        yield rows[[who, item]].assign(preference=[m[0] for m in met], observations=[m[1] for m in met])

    arriving = _arriving(outcomes, who, at, item, features, reward, weight)
    return arriving.groupBy(who).applyInPandasWithState(
        step, _schema(outcomes, who, item), "weights binary, squares binary, updated double, seen long", "append", GroupStateTimeout.NoTimeout
    )


def preference_points(preference: Column, observations: Column) -> Column:
    """What a preference adds to a candidate's rank: ten points either way, from 20 outcomes on in full."""
    return 20 * F.least(F.lit(1.0), observations / 20) * (preference - 0.5)


def training_due(outcomes: DataFrame, who: str, trained: DataFrame, every: int) -> DataFrame:
    """who and outcomes of those that have ``every`` more than at their last training. trained: (who, outcomes), one row each."""
    now = outcomes.groupBy(who).agg(F.count(F.lit(1)).alias("outcomes"))
    then = trained.toDF("__who", "__then")
    both = now.join(then, F.col(who).eqNullSafe(F.col("__who")), "left")
    return both.filter(F.col("outcomes") - F.coalesce("__then", F.lit(0)) >= every).select(who, "outcomes")
