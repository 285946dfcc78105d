"""What users plug in: signals that score candidates, providers that answer requests; mixes in order, vectors by version."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.ordering import first_wins


class Signal(Protocol):
    """A part of a score: ``prepare`` adds the columns it needs, a row staying a row; ``score`` is made of them."""

    def prepare(self, candidates: DataFrame) -> DataFrame: ...

    def score(self) -> Column: ...


def with_signals(candidates: DataFrame, signals: dict[str, tuple[Signal, float]]) -> DataFrame:
    """candidates with each signal's points under its name, and ``score``, their weighted sum; points that are unknown are none."""
    wide = candidates
    for name, (signal, _) in signals.items():
        kept = [c for c in wide.columns]
        wide = signal.prepare(wide).withColumn(f"__{name}", F.coalesce(signal.score().cast("double"), F.lit(0.0))).select(*kept, f"__{name}")
    total = sum((F.col(f"__{name}") * weight for name, (_, weight) in signals.items()), F.lit(0.0))
    return wide.select(*candidates.columns, *[F.col(f"__{name}").alias(name) for name in signals], total.alias("score"))


Provider = Callable[[DataFrame], DataFrame]


def ask_providers(asked: DataFrame, request: str, providers: list[Provider], identity: list[str], order: str, most: int) -> DataFrame:
    """Up to ``most`` answers to each request, with the number of their provider in ``part`` and their ``place`` from 1.

    A provider is a function of the requests that gives rows with the request, the identity and the order. Of rows of one
    identity the first provider's stays. Each provider is asked once for all requests and hands on its first ``most`` each.
    """
    head = Window.partitionBy(request).orderBy(order, *identity)
    own = Window.partitionBy(request, *identity).orderBy(order)
    answers = [p(asked).withColumn("__copy", F.row_number().over(own)).filter("__copy = 1").drop("__copy") for p in providers]
    # A row beyond the first `most` of its provider can't be among the first `most` of all: each row before it, or its
    # copy from an earlier provider, comes before it in the union too.
    answers = [a.withColumn("__n", F.row_number().over(head)).filter(F.col("__n") <= most).drop("__n") for a in answers]
    every = first_wins(answers, [request, *identity], order)
    return every.withColumn("place", F.row_number().over(Window.partitionBy(request).orderBy("part", order, *identity))).filter(F.col("place") <= most)


# The kinds of mixes that no count of plays would bring forward.
DISCOVERIES = ("fresh", "rediscover", "discover")


def order_mixes(mixes: DataFrame, who: str, kind: str, plays: str, place: str) -> DataFrame:
    """mixes with ``position``: favourites, the two played most of the rest, discoveries, then the rest by plays.

    place: in which order they were made; it decides between equals. A listener has a few mixes.
    """
    rest = ~F.col(kind).isin("favorites", *DISCOVERIES)
    ranked = mixes.withColumn("__rank", F.row_number().over(Window.partitionBy(who, rest).orderBy(F.desc(plays), place)))
    group = F.when(F.col(kind) == "favorites", 0).when(~rest, 2).when(F.col("__rank") <= 2, 1).otherwise(3)
    within = F.when(rest, F.col("__rank")).otherwise(0)
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(who).orderBy(group, within, place))).drop("__rank")


def put_vectors(store: DataFrame, analysed: DataFrame, path: str) -> DataFrame:
    """The store with what has been analysed in place of its paths' rows; a vector of null is an analysis that failed."""
    return store.join(analysed.select(path).distinct(), path, "left_anti").unionByName(analysed)


def get_vectors(store: DataFrame, wanted: DataFrame, path: str, vector: str, version: int) -> DataFrame:
    """path and vector of the wanted paths that this version has analysed; the version's filter reaches the scan."""
    current = store.filter((F.col("version") == version) & F.col(vector).isNotNull())
    return current.join(wanted.select(path).distinct(), path, "left_semi").select(path, vector)


def line_segments(lines: DataFrame, song: str, place: str, text: str) -> DataFrame:
    """song, place and segment: the number, from 0, of the line's text among the song's texts in order; null for a blank line."""
    said = lines.withColumn("__text", F.trim(F.coalesce(text, F.lit(""))))
    first = said.filter("__text != ''").groupBy(F.col(song).alias("__song"), F.col("__text").alias("__t")).agg(F.min(place).alias("__first"))
    numbered = first.withColumn("segment", F.row_number().over(Window.partitionBy("__song").orderBy("__first")) - 1)
    same = F.col(song).eqNullSafe(F.col("__song")) & (F.col("__text") == F.col("__t"))
    return said.join(numbered, same, "left").select(song, place, "segment")


def texts_digest(lines: DataFrame, song: str, place: str, text: str) -> DataFrame:
    """song and sha256 of its distinct texts in order, a line each. A song's texts are short, so one row may hold them."""
    said = lines.withColumn("__text", F.trim(F.coalesce(text, F.lit("")))).filter("__text != ''")
    first = said.groupBy(song, "__text").agg(F.min(place).alias("__first"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("__first", "__text"))), lambda x: x["__text"])
    return first.groupBy(song).agg(F.sha2(F.array_join(texts, "\n"), 256).alias("sha256"))


def distinct_events(events: DataFrame, event_id: str, start: str, place: str, venue: str, order: str) -> DataFrame:
    """events, each once with its ``key``: its id, or date, place and venue where it has none; the first in order stays. Without a place none is."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    key = F.when(text(event_id) != "", text(event_id)).otherwise(F.concat_ws("|", text(start), text(place), text(venue)))
    keyed = events.filter(text(place) != "").withColumn("key", key)
    return keyed.groupBy("key").agg(F.min_by(F.struct(*events.columns), order).alias("__row")).select("key", "__row.*")


# The library's orders, each its fields; those that fall, and those whose absence counts as 0.
LIBRARY_ORDERS = {
    "title": ("title", "artist", "album", "disc", "track"), "artist": ("artist", "album", "disc", "track", "title"),
    "latest": ("added", "album_artist", "album", "disc", "track"), "quality": ("depth", "rate", "bitrate", "album_artist", "album", "disc", "track"),
    "album": ("album_artist", "album", "disc", "track", "title"),
}
FALLING, ABSENT_IS_ZERO = ("added", "depth", "rate", "bitrate"), {"quality": ("depth", "rate", "bitrate"), "album": ("disc", "track")}


def library_terms(mode: str, fields: dict[str, str]) -> list[Column]:
    """The order of a mode ('title' for an unknown one): absent values first where they rise, last where they fall."""
    mode = mode if mode in LIBRARY_ORDERS else "title"
    terms = []
    for field in LIBRARY_ORDERS[mode]:
        c = F.col(fields[field])
        c = F.coalesce(c, F.lit(0)) if field in ABSENT_IS_ZERO.get(mode, ()) else c
        terms.append(c.desc_nulls_last() if field in FALLING else c.asc_nulls_first())
    return terms
