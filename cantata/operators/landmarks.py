"""Landmark fingerprints of tracks of spectra: peaks, pairs of peaks, and which track, how far in, shares most pairs.

A track is rows of (track, at, spectrum), at counting its frames from 0 without a gap. All is declared by windows and
joins; a long track is worked on in chunks of frames that see as far past their ends as the rules reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.checkpoints import checkpointed

#: Frames of a chunk, and index rows of one hash that meet in one place.
CHUNK, PART = 4096, 10_000


@dataclass(frozen=True)
class Shape:
    """What a peak has to beat. The defaults are fixed values, for spectra of 1,025 bins, 125 frames a second."""

    bins: tuple[int, ...] = (-10, -7, -4, -3, 1, 2, 5, 8)  # beside it, in the frame of ``before``
    frames: tuple[int, ...] = (-45, -38, -31, -24, -17, -10, -7, 1, 4, 11, 18, 25, 32, 39)  # around it, a bin below
    before: int = 3
    back: tuple[int, ...] = (1, 3, 6)  # the frames that a frame's strength is spread to
    up: int = 2  # and the bins
    least: float = 1 / 64
    lowest: int = 10
    highest: int = 1014
    level: tuple[float, float] = (1477.3, 6144.0)
    steps: int = 64  # parts of a bin

    @property
    def after(self) -> int:
        """Frames that must follow a peak's."""
        return max(0, *self.frames) + max(self.back)

    @property
    def reach(self) -> int:
        return max(-min(0, *self.frames), self.before) + max(self.back) + self.after


def _chunked(df: DataFrame, at: str, back: int, ahead: int) -> DataFrame:
    """Each row in the chunk of its frame and in those that see it from so many frames after, or before, theirs."""
    first, last = F.floor((F.col(at) - back) / CHUNK), F.floor((F.col(at) + ahead) / CHUNK)
    return df.withColumn("__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def peaks(frames: DataFrame, track: str, at: str, spectrum: str, shape: Shape = Shape()) -> DataFrame:
    """track, at, bin, place (the bin in parts, refined by a parabola) and magnitude of every peak.

    A strength of at least the least is a peak if the strengths around it, spread over the next bins and a few frames
    back, are below it. Frames before the first count as silent; the last ``after`` frames of a track have no peaks, as what
    follows them isn't known. Null strengths are silent, a null track is a track.
    """
    ranged = frames.groupBy(F.col(track).alias("__t")).agg(F.max(at).alias("__last"))
    clean = frames.select(track, at, F.transform(spectrum, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("__s"))
    within = lambda s, i: F.coalesce(F.get(s, i), F.lit(0.0))
    top = F.size("__s") - 1
    up = F.transform("__s", lambda x, i: F.when(i <= top - shape.up, F.greatest(x, *[within(F.col("__s"), i + k) for k in range(1, shape.up + 1)])).otherwise(x))
    chunked = _chunked(clean.withColumn("__u", up), at, shape.reach, shape.reach)
    w = Window.partitionBy(track, "__chunk").orderBy(at)
    later = F.array(F.col("__u"), *[F.coalesce(F.lead("__u", k).over(w), F.array().cast("array<double>")) for k in shape.back])
    spread = chunked.withColumn("__all", later).withColumn("__p", F.transform("__u", lambda _, i: F.array_max(F.transform("__all", lambda s: within(s, i)))))
    around = {k: F.lag("__p", -k).over(w) if k < 0 else F.lead("__p", k).over(w) for k in (-shape.before, *shape.frames)}
    none = F.array().cast("array<double>")
    seen = spread.select(track, at, "__chunk", "__s", F.coalesce(around[-shape.before], none).alias("__b"), F.array(*[F.coalesce(around[k], none) for k in shape.frames]).alias("__a"))
    seen = seen.filter(F.floor(F.col(at) / CHUNK) == F.col("__chunk"))
    # one projection makes the bins that may be peaks, those beside them tell
    each = seen.join(ranged, F.col(track).eqNullSafe(F.col("__t"))).filter(F.col(at) <= F.col("__last") - shape.after)
    strong = F.filter(F.sequence(F.lit(shape.lowest), F.least(F.lit(shape.highest), F.size("__s") - 2)), lambda i: F.get("__s", i) >= shape.least)
    beats = lambda i: (
        (F.get("__s", i) >= within(F.col("__b"), i - 1))
        & (F.get("__s", i) > F.greatest(*[within(F.col("__b"), i + k) for k in shape.bins], F.lit(0.0)))
        & F.forall("__a", lambda a: F.get("__s", i) > within(a, i - 1))
    )
    found = each.filter(F.size("__s") > shape.lowest + 1).select(track, at, "__s", F.explode(F.filter(strong, beats)).alias("bin"))
    scale, base = shape.level
    loud = lambda i: F.log(F.greatest(F.get("__s", i), F.lit(shape.least))) * scale + base
    told = found.select(track, at, "bin", loud(F.col("bin") - 1).alias("__below"), loud(F.col("bin")).alias("__peak"), loud(F.col("bin") + 1).alias("__above"))
    curve = 2 * F.col("__peak") - F.col("__below") - F.col("__above")
    place = F.col("bin") * shape.steps + (F.col("__above") - F.col("__below")) * (shape.steps / 2) / curve
    return told.filter(curve > 0).select(track, at, "bin", place.cast("int").alias("place"), F.col("__peak").cast("int").alias("magnitude"))


def pairs(found: DataFrame, track: str, at: str, bin_: str, fan: int = 5, ahead: int = 64) -> DataFrame:
    """track, at and hash of each peak with each of the next ``fan`` ones (by frame, then bin) at most ``ahead`` frames on.

    The hash has both bins and the frames between: 21 bits each, so that it is the pair and no digest.
    """
    chunked = _chunked(found.select(track, at, bin_), at, ahead, 0)
    w = Window.partitionBy(track, "__chunk").orderBy(at, bin_)
    nexts = F.array_compact(F.array(*[F.lead(F.struct(F.col(at).alias("at"), F.col(bin_).alias("bin")), k).over(w) for k in range(1, fan + 1)]))
    both = chunked.withColumn("__next", nexts).filter(F.floor(F.col(at) / CHUNK) == F.col("__chunk"))
    each = both.select(track, at, bin_, F.explode("__next").alias("n")).filter(F.col("n.at") - F.col(at) <= ahead)
    hashed = F.shiftleft(F.col(bin_).cast("long"), 42) + F.shiftleft(F.col("n.bin").cast("long"), 21) + (F.col("n.at") - F.col(at))
    return each.select(track, at, hashed.alias("hash"))


def votes(asked: DataFrame, index: DataFrame, query: str, track: str, at: str) -> DataFrame:
    """query, track, offset and how many pairs (query's rows: query, at, hash; index's: track, at, hash) agree on it.

    The offset is where in the track the query begins. A hash that the index has often is dealt over parts of PART rows,
    to each of which its askers go; votes are added up in each task before they move.
    """
    sizes = checkpointed(index.groupBy("hash").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > PART).select("hash", F.ceil(F.col("__n") / PART).cast("int").alias("__parts")))
    hot = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    parts = F.coalesce("__parts", F.lit(1))
    placed = index.join(hot, "hash", "left").select("hash", F.pmod(F.xxhash64(track, at), parts).cast("int").alias("__part"), track, F.col(at).alias("__there"))
    sought = asked.join(hot, "hash", "left").select("hash", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"), query, F.col(at).alias("__here"))
    return sought.join(placed, ["hash", "__part"]).groupBy(query, track, (F.col("__there") - F.col("__here")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))


def best_match(counted: DataFrame, query: str, track: str, least: int = 3) -> DataFrame:
    """Each query's track and offset of the most votes, at least so many; ties: the lowest track, then offset."""
    order = Window.partitionBy(query).orderBy(F.desc("votes"), track, "offset")
    return counted.filter(F.col("votes") >= least).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
