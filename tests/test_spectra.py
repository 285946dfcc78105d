import math
import random

import numpy as np
import pytest

from cantata.operators import spectra


def plain_features(samples, rate):
    """One frame's features by sums, without a transform of numpy's."""
    n = len(samples)
    shaped = [s * (0.5 - 0.5 * math.cos(2 * math.pi * i / n)) for i, s in enumerate(samples)]
    power = [abs(sum(s * complex(math.cos(2 * math.pi * b * i / n), -math.sin(2 * math.pi * b * i / n)) for i, s in enumerate(shaped))) ** 2 for b in range(n // 2 + 1)]
    hz, total = [b * rate / n for b in range(len(power))], sum(power[1:])
    run, roll = 0.0, 0
    for b in range(1, len(power)):
        run += power[b]
        if run >= 0.85 * total:
            roll = hz[b]
            break
    chroma = [0.0] * 12
    for b, p in enumerate(power):
        if hz[b] >= 55:
            chroma[round(12 * math.log2(hz[b] / 440) + 9) % 12] += p
    flat = math.exp(sum(math.log(p) for p in power[1:]) / (len(power) - 1)) / (total / (len(power) - 1))
    return 10 * math.log10(sum(s * s for s in samples) / n), sum(p * h for p, h in zip(power[1:], hz[1:], strict=True)) / total, roll, flat, [c / sum(chroma) for c in chroma]


def test_frames_and_tracks(spark):
    rng = random.Random(1)
    rows = [("a", i, [rng.gauss(0, 0.3) + math.sin(2 * math.pi * 440 * s / 8000) for s in range(64)]) for i in range(5)] + [("b", 0, [0.0] * 64), ("c", 0, None), ("c", 1, [0.5, None, -0.5, 0.25])]
    df = spark.createDataFrame(rows, "track string, at int, samples array<double>")
    framed = spectra.frame_features(df, ["track", "at"], "samples", 8000.0)
    got = {(r["track"], r["at"]): r for r in framed.collect()}
    assert set(got) == {("a", i) for i in range(5)} | {("b", 0), ("c", 1)}
    for name, at, samples in rows[:5]:
        level, centroid, roll, flat, chroma = plain_features(samples, 8000)
        r = got[name, at]
        assert (r["level"], r["centroid"], r["rolloff"], r["flatness"]) == pytest.approx((level, centroid, roll, flat)) and r["chroma"] == pytest.approx(chroma)
        assert len(r["cepstra"]) == 13
    vectors = {r["track"]: r["vector"] for r in spectra.track_features(framed, "track").collect()}
    assert set(vectors) == {"a", "c"} and len(vectors["a"]) == 2 * 29  # silence isn't heard
    assert vectors["a"][0] == pytest.approx(np.mean([got["a", i]["level"] for i in range(5)]))
    assert spectra.frame_features(df.limit(0), ["track", "at"], "samples", 8000.0).count() == 0


@pytest.mark.parametrize("bpm", [83.0, 120.0, 171.5])
def test_planted_beats_are_found(spark, bpm):
    fps, rng = 86.0, random.Random(2)
    onset = [abs(rng.gauss(0, 0.05)) for _ in range(2000)]
    beat = 20.0
    while beat < 1999:
        onset[min(1999, round(beat + rng.uniform(-0.8, 0.8)))] += 1.0  # with jitter
        beat += fps * 60 / bpm
    rows = [("x", i, o, 0.0 if i < 10 else 0.1) for i, o in enumerate(onset)] + [("silent", i, 1.0, 0.0) for i in range(900)] + [("short", i, 1.0, 1.0) for i in range(100)] + [(None, i, 0.5, 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "track string, at int, onset double, energy double")
    got = {r["track"]: r for r in spectra.beat_grids(df, "track", "at", "onset", "energy", fps).collect()}
    x = got["x"]
    octave = 2.0 ** round(math.log2(x["bpm"] / bpm))  # half of a beat, or every other one, is the same beat
    assert octave in (0.5, 1.0, 2.0) and x["bpm"] == pytest.approx(bpm * octave, rel=0.01) and x["confidence"] > 0.4 and x["first_sound"] == pytest.approx(10 / fps)
    gap = (x["phase"] * fps - 20) % (fps * 60 / bpm)
    assert min(gap, fps * 60 / bpm - gap) <= 8  # a tempo off by a part in three hundred drifts as far
    assert got["silent"]["bpm"] == got["short"]["bpm"] == got[None]["bpm"] == 0
    parts = spectra.beat_grids(df.filter("track = 'x'"), "track", "at", "onset", "energy", fps, 1000).collect()
    assert sorted(r["window"] for r in parts) == [0, 1]
