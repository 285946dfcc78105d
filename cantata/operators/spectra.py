"""Frames of samples to spectra and their features, and onset strengths to beats: numpy on Arrow batches, sums by Spark."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Mel bands and cepstra, the part of the power that a roll-off is above, the reference of pitch classes.
MEL_BANDS, CEPSTRA, ROLL_OFF, A4 = 40, 13, 0.85, 440.0
# Fixed values of beats: tempos tried, in quarters of a beat a minute, and how fine; what is preferred; reach of the local
# mean and of the local power; the most an onset counts; seconds that a grid takes; what is silent; a hit's part of the best.
SLOWEST, FASTEST, FINE, FINE_STEPS = 240, 720, 0.01, 25
PREFERRED, SPREAD, FAVOUR = 120.0, 45.0, 0.04
MEAN_REACH, POWER_REACH, MOST, LEAST_SECONDS, SILENT, HIT = 8, 43, 6.0, 6.0, 1e-5, 0.3
#: Frames of a track that one grid is found in; longer tracks have several.
WINDOW = 16_384


def mel_filters(bins: int, rate: float, bands: int = MEL_BANDS) -> np.ndarray:
    """bands x bins: triangles that are even in mel from 20 Hz up; one narrower than a bin takes its nearest."""
    to_mel, to_hz = (lambda hz: 2595 * np.log10(1 + hz / 700)), (lambda mel: 700 * (10 ** (mel / 2595) - 1))
    edges = to_hz(np.linspace(to_mel(20.0), to_mel(rate / 2), bands + 2))
    hz = np.arange(bins) * rate / 2 / (bins - 1)
    left, middle, right = (edges[i : i + bands, None] for i in range(3))
    weights = np.maximum(0, np.minimum((hz - left) / (middle - left), (right - hz) / (right - middle)))
    for band in np.flatnonzero(weights[:, 1:].sum(axis=1) == 0):
        weights[band, min(bins - 1, max(1, round(edges[band + 1] / hz[1])))] = 1.0
    weights[:, 0] = 0.0
    return weights


def features(samples: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Rows of samples (all as long) to their level, centroid, roll-off, flatness, cepstra and pitch classes."""
    n = samples.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft(samples * window, axis=1)) ** 2
    bins = power.shape[1]
    hz, rest = np.arange(bins) * rate / n, power[:, 1:]
    total = np.maximum(rest.sum(axis=1), 1e-20)
    cumulative = np.cumsum(rest, axis=1)
    rolled = (cumulative < ROLL_OFF * cumulative[:, -1:]).sum(axis=1) + 1
    mel = np.log(np.maximum(power @ mel_filters(bins, rate).T, 1e-10))
    k, band = np.arange(1, CEPSTRA + 1)[:, None], np.arange(MEL_BANDS)[None, :] + 0.5
    cosines = math.sqrt(2 / MEL_BANDS) * np.cos(math.pi * k * band / MEL_BANDS)
    pitch = np.zeros((12, bins))
    at = np.flatnonzero(hz >= 55)
    pitch[np.round(12 * np.log2(hz[at] / A4) + 9).astype(int) % 12, at] = 1.0
    chroma = power @ pitch.T
    return {
        "level": 10 * np.log10(np.maximum((samples**2).mean(axis=1), 1e-10)),
        "centroid": (rest @ hz[1:]) / total,
        "rolloff": hz[np.minimum(rolled, bins - 1)],
        "flatness": np.exp(np.log(np.maximum(rest, 1e-20)).mean(axis=1)) / np.maximum(rest.mean(axis=1), 1e-20),
        "cepstra": mel @ cosines.T,
        "chroma": chroma / np.maximum(chroma.sum(axis=1, keepdims=True), 1e-20),
    }


def frame_features(frames: DataFrame, keys: list[str], samples: str, rate: float) -> DataFrame:
    """keys with level, centroid, rolloff, flatness (doubles), cepstra and chroma (arrays) of every frame.

    Frames of one batch that are as long are transformed together. Null samples are silent; a frame of fewer than two samples has none.
    """
    single, listed = ("level", "centroid", "rolloff", "flatness"), ("cepstra", "chroma")

    def run(batches):
        for batch in batches:
            rows = batch.column(len(keys)).to_pylist()
            sizes = np.array([len(r or ()) for r in rows])
            for size in np.unique(sizes[sizes > 1]):
                at = np.flatnonzero(sizes == size)
                told = features(np.nan_to_num(np.array([rows[i] for i in at], dtype=float)), rate)
                columns = [pa.array(told[c]) for c in single] + [pa.array(list(told[c]), pa.list_(pa.float64())) for c in listed]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns[: len(keys)], *columns], names=[*keys, *single, *listed])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} double" for c in single), *(f"{c} array<double>" for c in listed)])
    return frames.select(*keys, samples).mapInArrow(run, schema)


def track_features(framed: DataFrame, track: str, quiet: float = -60.0) -> DataFrame:
    """track and vector: means and deviations of the features of its audible frames, in one order; summed a number at a time."""
    single = [F.array(F.col(c)) for c in ("level", "centroid", "rolloff", "flatness")]
    each = framed.filter(F.col("level") > quiet).select(track, F.posexplode(F.concat(*single, F.col("cepstra"), F.col("chroma"))).alias("d", "x"))
    stats = each.groupBy(track, "d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    gathered = stats.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("d", "mean", "sd"))).alias("all"))
    return gathered.select(track, F.flatten(F.array(F.transform("all", lambda s: s["mean"]), F.transform("all", lambda s: s["sd"]))).alias("vector"))


def _around(x: np.ndarray, reach: int) -> np.ndarray:
    """The mean of x within reach of each place, of what there is."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    low, high = np.maximum(0, np.arange(len(x)) - reach), np.minimum(len(x), np.arange(len(x)) + reach + 1)
    return (sums[high] - sums[low]) / (high - low)


def strength(onset: np.ndarray) -> np.ndarray | None:
    """Onsets above their local mean, by their local power; None where nothing stands out."""
    above = np.maximum(0.0, onset - _around(onset, MEAN_REACH))
    total = (above**2).sum()
    return None if total < 1e-6 else np.minimum(MOST, above / np.sqrt(np.maximum(total / len(above) * 0.01, _around(above**2, POWER_REACH))))


def _agreement(x: np.ndarray, lag: float) -> float:
    """How well x agrees with itself a lag (of any fraction) before."""
    here = np.arange(math.ceil(lag), len(x))
    before = np.interp(here - lag, np.arange(len(x)), x)
    return float(x[here] @ before / math.sqrt(max(1e-9, (x[here] @ x[here]) * (before @ before))))


def beat_grid(onset: np.ndarray, energy: np.ndarray, fps: float) -> tuple[float, float, float, float]:
    """bpm, phase (seconds), confidence and first sound (seconds) of evenly timed frames; a bpm of 0 where there is no beat."""
    if len(onset) < fps * LEAST_SECONDS or energy.max(initial=0.0) < SILENT:
        return 0.0, 0.0, 0.0, 0.0
    first = float(np.argmax(energy > max(SILENT, energy.max() * 1e-4))) / fps
    x = strength(onset)
    if x is None:
        return 0.0, 0.0, 0.0, first
    score = lambda bpm: _agreement(x, fps * 60 / bpm) * (1 - FAVOUR + FAVOUR * math.exp(-(((bpm - PREFERRED) / SPREAD) ** 2)))
    best = max((score(q / 4), -q) for q in range(SLOWEST, FASTEST + 1))
    if best[0] <= 0:
        return 0.0, 0.0, 0.0, first
    coarse = -best[1] / 4
    near = [coarse + i * FINE for i in range(-FINE_STEPS, FINE_STEPS + 1) if SLOWEST / 4 <= coarse + i * FINE <= FASTEST / 4]
    sure, bpm = max([(best[0], coarse), *((score(b), b) for b in near)], key=lambda s: s[0])
    period = fps * 60 / bpm
    places = lambda phase, less: np.floor(np.arange(phase, len(x) - less, period) + 0.5).astype(int)
    means = [(x[places(p, 1)].mean() if len(places(p, 1)) else 0.0, -p) for p in np.arange(0, period, 0.5)]
    top, phase = max(means)
    on = places(-phase, 2)
    peak = np.max([x[on], x[np.maximum(0, on - 1)], x[np.minimum(len(x) - 1, on + 1)]], axis=0) if len(on) else np.zeros(0)
    return bpm, -phase / fps, float(min(sure, (peak >= HIT * top).mean() if len(on) else 0.0)), first


def beat_grids(frames: DataFrame, track: str, at: str, onset: str, energy: str, fps: float, window: int = WINDOW) -> DataFrame:
    """track, window, bpm, phase, confidence and first_sound of every stretch of window frames of a track (at counts them from 0)."""
    kind = frames.schema[track].dataType.simpleString()

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        x, e = (np.nan_to_num(table[c].to_numpy(zero_copy_only=False).astype(float)) for c in (onset, energy))
        told = [pa.array([v], pa.float64()) for v in beat_grid(x, e, fps)]
        return pa.Table.from_arrays([table[track].slice(0, 1), table["window"].slice(0, 1), *told], names=[track, "window", "bpm", "phase", "confidence", "first_sound"])

    placed = frames.select(track, at, onset, energy, F.floor(F.col(at) / window).alias("window"))
    return placed.groupBy(track, "window").applyInArrow(found, f"`{track}` {kind}, window long, bpm double, phase double, confidence double, first_sound double")
