"""Loose matches, families, places, lyrics and the learner on small tables: edges of the rules, unknowns, empties, ties."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from cantata.functions import matching as m
from cantata.functions import places
from cantata.operators import learning, signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(*values):
    return [F.lit(v).cast("string") for v in values]


@pytest.mark.parametrize(
    ("a", "b", "alike"),
    [
        ("Beyoncé", "beyonce", True), ("A & B", "C, B", True), ("Lee Ann", "Ann Lee", True), ("Ann", "Bob", False), ("Кино", "Kino", True),
        ("Ann", None, True), (None, None, True), ("Ann feat. Cy", "Cy", True), ("Ann x Bo", "Bo x Di", True), ("Al, Bo", "Cy; Di", False),
    ],
)
def test_artists(spark, a, b, alike):
    assert one(spark, m.artists_match(*texts(a, b))) is alike


@pytest.mark.parametrize(
    ("a", "b", "alike", "same_recording"),
    [
        ("Song", "Song (Live)", True, False), ("Song (Live)", "Song (Acoustic)", True, False), ("Song - Remastered", "Song [Deluxe]", True, True),
        ("Song (feat. X)", "Song", True, True), ("Song (with X)", "Song", True, True), ("Alpha", "Beta", False, False), ("Song remix", "Song", True, False),
        ("(A) Song", "(B) Song", False, False), ("Song (with Live Band)", "Song", True, False), ("+++", "+++!", True, True), ("÷", "×", False, False), (None, "x", True, True), ("", "", True, True),
    ],
)
def test_titles(spark, a, b, alike, same_recording):
    assert (one(spark, m.titles_match(*texts(a, b))), one(spark, m.track_titles_match(*texts(a, b)))) == (alike, same_recording)


def test_only_version_notes_at_the_end_go(spark):
    cut = lambda s: one(spark, m._without_versions(F.lit(s)))
    assert cut("song (live) (2020)") == "song (live) (2020)"
    assert cut("song (2020) (live) [bonus]") == "song (2020)"
    assert cut("song - live - remaster") == "song"
    assert cut("song (live") == "song (live"


def test_names_and_keys(spark):
    assert one(spark, m.plain_ascii(F.lit("Härd  Song (Radio Edit) (Live)"))) == "hrd song"
    assert one(spark, m.plain_ascii(F.lit(None).cast("string"))) == ""
    assert one(spark, m.suggestion_key(*texts("A [b] C", "Q & R"))) == "name:a c|q"
    assert one(spark, m.suggestion_key(*texts(None, None))) == "name:|"


def test_families(spark):
    families = {"rock": ["rock", "hard rock"], "jazz": ["jazz", "jazz rock fusion"], "rnb": ["rnb"]}
    told = lambda s: one(spark, m.genre_families(F.lit(s).cast("string"), families))
    assert told("Jazz Rock") == ["rock"] and told("Rock Jazz; hard rock") == ["jazz", "rock"]
    assert told("jazz rock fusion") == ["jazz"] and told("R'n'B / R and B") == ["rnb"]
    assert told("Rocky, 80, Misc, " + "x" * 41) == ["tag:rocky"] and told(None) == [] and told("") == []


def test_places(spark):
    at = lambda s: one(spark, places.file_location(F.lit(s).cast("string")))
    assert at("/a.flac").asDict() == {"root": "/", "label": "/", "folders": [], "file": "a.flac"}
    assert at("c:/M/a.cue#track12").asDict() == {"root": "C:", "label": "C:\\", "folders": ["M"], "file": "a.cue"}
    assert at("content://media.docs/tree/x%2Fy/a%20b").asDict() == {"root": "content://media.docs", "label": "media.docs", "folders": [], "file": "a b"}
    assert at("network://h/a%2/b").file == "b"
    assert [at(s) for s in (None, "", "a.flac", "/", "network://h", "network:///x")] == [None] * 6


def test_event_times(spark):
    at = lambda s, zone: one(spark, places.event_time(*texts(s, zone)))
    assert tuple(at("2024-07-01T20:30:00Z", "America/New_York")) == (datetime.datetime(2024, 7, 1, 16, 30), True)
    assert tuple(at("2024-01-01T00:30+0100", "UTC")) == (datetime.datetime(2023, 12, 31, 23, 30), True)
    assert tuple(at("2024-01-01T00:30+01:00", "Mars/Base")) == (datetime.datetime(2024, 1, 1, 0, 30), True)
    assert tuple(at(" 2024-02-29 ", None)) == (datetime.datetime(2024, 2, 29), False)
    assert [at(s, "UTC") for s in ("2023-02-29", "2024-01-01T24:00", "2024-01-01T10:60", "2024-1-1", "", None)] == [None] * 6


def test_lyrics(spark):
    assert one(spark, m.plain_lyrics(F.lit("[ti:x]\n[00:01.00] [00:02]V2: a  b\n[BG:c]\nplain"))) == "a b\nc\nplain"
    assert [one(spark, m.has_lyrics(*texts(s))) for s in ("[ti:x]\n", "[instrumental:true]", None, "a")] == [False, True, False, True]


def by_hand(outcomes):
    """The learner written out with a dictionary: outcomes are (features, reward, weight, day)."""
    weights, squares, last, seen, met = {}, {}, None, 0, []
    for features, reward, weight, day in outcomes:
        value = {}
        for index, sign in features:
            value[index] = value.get(index, 0) + sign
        norm = math.sqrt(sum(v * v for v in value.values())) or 1
        value = {i: v / norm for i, v in value.items()}
        chance = lambda: 1 / (1 + math.exp(-max(-20, min(20, sum(weights.get(i, 0) * v for i, v in value.items())))))  # noqa: B023, E731
        met.append((chance(), seen))
        if reward is None or not weight or not value:
            continue
        if last is not None and day > last:
            left = 0.98 ** min(90, day - last)
            weights, squares = {i: w * left for i, w in weights.items()}, {i: s * left for i, s in squares.items()}
        error = (chance() - max(0, min(1, reward))) * min(weight, 4)
        for i, v in value.items():
            slope = error * v + 0.001 * weights.get(i, 0)
            squares[i] = squares.get(i, 0) + slope * slope
            weights[i] = max(-8, min(8, weights.get(i, 0) - 0.18 * slope / math.sqrt(squares[i] + 0.01)))
        seen, last = seen + 1, day if last is None else max(day, last)
    return met


HISTORY = [
    ([(1, 1), (5, -1)], 1.0, 1.0, 0), ([(1, 1), (1, 1), (9, 1)], 0.0, 9.0, 0), ([(5, -1)], 2.0, 0.5, 3), ([], 1.0, 1.0, 3), ([(1, 1)], None, 1.0, 4),
    ([(1, 1)], 1.0, 0.0, 5), ([(9, 1), (5, -1)], 0.3, 2.0, 200), ([(1, 1), (9, -1)], 1.0, 4.0, 201),
]
KIND = "who string, item long, at timestamp, features array<struct<index int, sign int>>, reward double, weight double"


def history(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(who, i, start + datetime.timedelta(day), f, r, w) for who in ("a", "b", None) for i, (f, r, w, day) in enumerate(HISTORY)]
    return spark.createDataFrame(rows, KIND)


def agree(rows):
    wanted = by_hand(HISTORY)
    assert len(rows) == 3 * len(HISTORY)
    for r in rows:
        assert (r["preference"], r["observations"]) == (pytest.approx(wanted[r["item"]][0], abs=1e-12), wanted[r["item"]][1])


def test_preferences_are_those_worked_by_hand(spark):
    df = history(spark)
    learn = lambda df: learning.learn_preferences(df, "who", "at", "item", F.col("features"), F.col("reward"), F.col("weight"), 64)
    agree(learn(df.orderBy(F.desc("item"))).collect())
    assert learn(df.limit(0)).count() == 0
    unknown = learn(df.select("who", "item", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast(df.schema["features"].dataType).alias("features"), "reward", "weight"))
    assert {(r["preference"], r["observations"]) for r in unknown.collect()} == {(0.5, 0)}


def test_preferences_of_a_stream_are_the_same(spark, tmp_path):
    df, folder = history(spark), f"{tmp_path}/in"
    for part in ("item < 3", "item >= 3"):
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    learnt = learning.learn_preferences_stream(stream, "who", "at", "item", F.col("features"), F.col("reward"), F.col("weight"), 64)
    learnt.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    agree(spark.read.parquet(f"{tmp_path}/out").collect())


def test_features_of_an_outcome(spark):
    track = dict(zip(("title", "artist", "album", "genre"), texts("T", " Ann ", "", "Rock, rock;Pop/Jazz"), strict=True)) | {"seconds": F.lit(1000)}
    found = one(spark, learning.preference_features(track, {"artist": F.lit("ann"), "genre": F.lit("pop")}, F.lit(13)))
    # artist, song, two genres, artist and genres by time, transitions of both, flow of both, duration; no album
    assert len(found) == 1 + 1 + 2 + 1 + 2 + 1 + 2 + 2 + 1
    blank = dict.fromkeys(("title", "artist", "album", "genre"), F.lit(None).cast("string")) | {"seconds": F.lit(None).cast("int")}
    assert one(spark, learning.preference_features(blank, {"artist": F.lit(None).cast("string"), "genre": F.lit("x")}, F.lit(1))) == []


def test_answers_of_providers(spark):
    asked = spark.createDataFrame([("q",), ("r",)], "request string")
    answers = {1: [("q", "a", 1), ("q", "a", 0), ("q", "b", 2)], 2: [("q", "b", 0), ("q", "c", 1), ("r", "c", 5)], 3: []}
    providers = [lambda df, rows=rows: spark.createDataFrame(rows, "request string, id string, place_of int") for rows in answers.values()]
    got = signals.ask_providers(asked, "request", providers, ["id"], "place_of", 2).collect()
    assert sorted((r["request"], r["id"], r["place_of"], r["part"], r["place"]) for r in got) == [("q", "a", 0, 0, 1), ("q", "b", 2, 0, 2), ("r", "c", 5, 1, 1)]


def test_training_is_due_again(spark):
    outcomes = spark.createDataFrame([("a",)] * 5 + [(None,)] * 3 + [("b",)], "who string")
    due = lambda rows: sorted((r["who"] or "", r["outcomes"]) for r in learning.training_due(outcomes, "who", spark.createDataFrame(rows, "who string, n long"), 3).collect())
    assert due([]) == [("", 3), ("a", 5)] and due([("a", 2), (None, 1)]) == [("a", 5)] and due([("a", 3)]) == [("", 3)]
