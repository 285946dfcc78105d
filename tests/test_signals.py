"""Landmarks, spacing, feeds and the kept index on small tables, against the same rules over lists."""

import random

import pytest
from pyspark.sql import functions as F

from cantata.functions import dates
from cantata.operators import feed, landmarks, mixing, search_index, spacing
from cantata.sources import markup


def spectra(seed, frames=160, bins=40):
    rng = random.Random(seed)
    return [[rng.random() ** 6 for _ in range(bins)] for _ in range(frames)]


def plain_peaks(frames, shape):
    last, bins = len(frames) - 1, len(frames[0])
    up = [[max(f[b : b + shape.up + 1]) if b < bins - shape.up else f[b] for b in range(bins)] for f in frames]
    spread = [[max(up[i + k][b] if i + k <= last else 0 for k in (0, *shape.back)) for b in range(bins)] for i in range(last + 1)]
    at = lambda i, b: spread[i][b] if 0 <= i <= last and 0 <= b < bins else 0.0
    for i in range(last - shape.after + 1):
        for b in range(shape.lowest, min(shape.highest, bins - 2) + 1):
            e = frames[i][b]
            if e >= shape.least and e >= at(i - shape.before, b - 1) and all(e > at(i - shape.before, b + k) for k in shape.bins) and all(e > at(i + k, b - 1) for k in shape.frames) and e > 0:
                yield i, b


def table(spark, tracks):
    rows = [(name, i, f) for name, frames in tracks.items() for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "track string, at int, s array<double>")


def test_peaks_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(landmarks, "CHUNK", 50)
    shape = landmarks.Shape(bins=(-3, 1), frames=(-7, 1, 4), before=2, back=(1, 3), up=1, lowest=5, highest=36)
    one, two = spectra(1), spectra(2, 70)
    got = landmarks.peaks(table(spark, {"a": one, None: two}), "track", "at", "s", shape)
    found = {(r["track"], r["at"], r["bin"]) for r in got.collect()}
    wanted = {("a", i, b) for i, b in plain_peaks(one, shape)} | {(None, i, b) for i, b in plain_peaks(two, shape)}
    assert len(wanted) > 15 and found <= wanted and len(wanted - found) <= 2  # those without a bend are left out
    default = landmarks.Shape()
    assert (default.after, default.reach) == (45, 96)
    assert landmarks.peaks(table(spark, {}), "track", "at", "s", shape).count() == 0


def test_a_shifted_and_thinned_copy_is_found(spark, monkeypatch):
    monkeypatch.setattr(landmarks, "CHUNK", 64)
    monkeypatch.setattr(landmarks, "PART", 3)  # every hash that comes four times is dealt over parts
    rng = random.Random(4)
    rows = [(t, i, rng.randrange(12)) for t in "abcdef" for i in range(0, 400, 3)]
    found = spark.createDataFrame(rows, "track string, at int, bin int")
    index = landmarks.pairs(found, "track", "at", "bin", ahead=16)
    asked = found.filter("track IN ('b', 'e') AND at BETWEEN 120 AND 240 AND at % 5 <> 0").select(F.concat("track", F.lit("?")).alias("q"), (F.col("at") - 120).alias("at"), "bin")
    best = landmarks.best_match(landmarks.votes(landmarks.pairs(asked, "q", "at", "bin", ahead=16), index, "q", "track", "at"), "q", "track").collect()
    assert {(r["q"], r["track"], r["offset"]) for r in best} == {("b?", "b", 120), ("e?", "e", 120)}
    monkeypatch.setattr(landmarks, "PART", 10_000)
    plain = landmarks.votes(landmarks.pairs(asked, "q", "at", "bin", ahead=16), index, "q", "track", "at")
    assert plain.agg(F.sum("votes")).first()[0] > 100
    hashes = lambda d: sorted(map(tuple, d.collect()))
    monkeypatch.setattr(landmarks, "CHUNK", 4096)
    assert hashes(landmarks.pairs(found, "track", "at", "bin", ahead=16)) == hashes(index)  # chunks change nothing


def plain_spaced(places, gap):
    out = []
    for p in sorted(places):
        if not out or p - out[-1] >= gap:
            out.append(p)
    return out


@pytest.mark.parametrize("gap", [1, 4, 16])
def test_rows_that_stay_apart(spark, monkeypatch, gap):
    monkeypatch.setattr(spacing, "CHUNK", 16)
    rng = random.Random(gap)
    rows = {"hot": list(range(900)), "thin": sorted(rng.sample(range(5000), 60)), None: sorted(rng.sample(range(300), 200))}
    df = spark.createDataFrame([(k, p, -p) for k, ps in rows.items() for p in ps], "k string, at int, more int")
    got = spacing.spaced(df, "k", "at", gap)
    assert got.columns == df.columns
    assert {k: sorted(r["at"] for r in got.collect() if r["k"] == k) for k in rows} == {k: plain_spaced(ps, gap) for k, ps in rows.items()}
    assert spacing.spaced(df.limit(0), "k", "at", gap).count() == 0


def test_quantiles_are_those_of_sorted_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 3, 9, 9, 9, 2, 0, 4)] + [(None, 7.0)], "k string, v double")
    assert {r["k"]: r["quantile"] for r in spacing.quantile_row(df, "k", "v", 0.9).collect()} == {"a": 9.0, None: 7.0}
    assert {r["k"]: r["quantile"] for r in spacing.quantile_row(df, "k", "v", 0.5).collect()} == {"a": 4.0, None: 7.0}


def test_followers_of_a_feed_know_what_is_there(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abcdefgh"), i, rng.random() < 0.3, i * 10) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "item string, seq int, gone boolean, amount int")
    state = lambda upto: {r[0]: r[3] for r in rows if r[1] <= upto and r == max((x for x in rows if x[0] == r[0] and x[1] <= upto), key=lambda x: x[1]) and not r[2]}
    table_ = feed.compacted(feed.compacted(df.filter("seq <= 40"), "item", "seq", F.col("gone"), 20).drop("removed").unionByName(df.filter("seq > 40")), "item", "seq", F.col("gone"), 30)
    for since in (0, 10, 29, 30, 45, 58, 59, 80):
        told = feed.delta(table_, "seq", since, 30)
        reset = 0 < told.count() and told.first()["reset"]
        assert reset == (since < 30)
        known = spark.createDataFrame([(k, v) for k, v in state(since).items()], "item string, amount int")
        after = feed.followed(known, told, "item", reset)
        assert {r["item"]: r["amount"] for r in after.collect()} == state(59)
    assert table_.filter("removed AND seq < 30").count() == 0
    assert feed.delta(table_.limit(0), "seq", 0, 30).count() == 0


def test_only_the_phrases_partitions_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "LIST", 5)  # common grams have many lists
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"common words {'needle in hay' if i % 7 == 0 else 'need led le'} {i}") for i in range(60)] + [(97, None), (98, ""), (99, "ab")], "id int, text string")
    search_index.write_index(docs, "id", F.col("text"), path)
    found = lambda now, phrase: sorted(r["id"] for r in search_index.search(now, "id", F.col("text"), path, phrase).collect())
    assert found(docs, "NEEDLE") == [i for i in range(60) if i % 7 == 0]
    near = sorted(r["id"] for r in search_index.candidates(spark, path, "eed led le").collect())
    assert near == [i for i in range(60) if i % 7] and found(docs, "ab") == [99] and found(docs, "led lex") == []
    plan = search_index.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    buckets = {search_index.bucket_of(g) for g in search_index.grams_of("needle")}
    assert "PartitionFilters: [" in plan and all(str(b) in plan.split("PartitionFilters: [")[1].split("]")[0] for b in buckets)
    changed = spark.createDataFrame([(0, "nothing here"), (1, "a needle now"), (200, "Needles")], "id int, text string")
    search_index.add_delta(changed, "id", F.col("text"), docs.filter("id = 7"), path, 1)
    now = docs.filter("id NOT IN (0, 1, 7)").unionByName(changed)
    assert found(now, "needle") == sorted([1, 200, *[i for i in range(14, 60) if i % 7 == 0]])
    assert 7 not in [r["id"] for r in search_index.candidates(spark, path, "needle").collect()]
    search_index.add_delta(docs.filter("id = 0"), "id", F.col("text"), docs.limit(0), path, 2)
    assert 0 in [r["id"] for r in search_index.candidates(spark, path, "needle").collect()]


def test_dates_of_tags(spark):
    told = {
        "1995-03-04": "4", "1995/03/04": "4", "1995.03.04": "4", "1995-03/04": "1", "1995-03": "1", "1995": "1", "1995-03-04T10:11:12Z": "4", "1995-03-04T23:11:12,5-07:00": "4",
        "1995-03-04T10:11:12+25:00": "4", "1995-03-04 and more": "4", "1995/03/04 x": "1", "about 1995": "1", "1995-13-04": "1", " 1995 ": "1", "995": "", "": "", None: "", "x0000": "",
    }
    df = spark.createDataFrame([(t,) for t in told], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", dates.date_text(F.col("t"), "%Y|%d|%%|%z|%").alias("s")).collect()}
    assert got == {t: f"1995|0{d}|%|%z|%" if d else "" for t, d in told.items()}
    assert df.select(dates.date_text(F.col("t"), "").alias("s")).distinct().count() == 1


def test_markup_without_a_line(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<tt><body/></tt>"), (4, "<p"), (5, "<tt><body><div><p>untimed</p></div></body></tt>")], "id int, x string")
    assert markup.ttml_lines(df, "x").count() == 0 and markup.webdav_entries(df, "x").count() == 0


def test_learned_weights_must_win(spark):
    rng, rows = random.Random(8), []
    for who in ("sense", "one", "few", None):
        for i in range({"few": 39}.get(who, 80)):
            x, y = rng.random(), rng.random()
            kept = who == "one" or x - 2 * y + rng.gauss(0, 0.2) > -0.5
            rows.append((who, i, x, y, kept, 1.0))
    df = spark.createDataFrame(rows, "who string, at int, x double, y double, kept boolean, w double")
    decision, weights = mixing.champions(df, "who", "at", "at", ["x", "y"], F.col("kept"), "w")
    told = {r["who"]: r for r in decision.collect()}
    assert [(told[w]["outcomes"], told[w]["tested"], told[w]["wins"]) for w in ("sense", "one", "few", None)] == [(80, 20, True), (80, 20, False), (39, None, False), (80, 20, True)]
    assert told["one"]["starting"] is None and told["one"]["learned"] is None and told["few"]["learned"] is None

    def auc(score, who):
        latest = [r for r in rows if r[0] == who][-20:]
        pairs = [(score(a), score(b)) for a in latest if a[4] for b in latest if not b[4]]
        return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)

    assert told["sense"]["starting"] == pytest.approx(auc(lambda r: r[2] + r[3], "sense"))
    found = {(r["who"], r["feature"]): r["coefficient"] for r in weights.collect()}
    assert {w for w, _ in found} == {"sense", None} and found["sense", "y"] < 0 < found["sense", "x"]
    assert told["sense"]["learned"] > 0.8
    assert mixing.champions(df.limit(0), "who", "at", "at", ["x", "y"], F.col("kept"), "w")[0].count() == 0
