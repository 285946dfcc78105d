import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from cantata.operators import mixing
from cantata.streaming import keyed

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, keyed.STATE_STORE)
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, schema, parts, operator):
    """The rows that a stream gives, over a trigger for each part, stopped and begun again after each."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = operator(spark.readStream.schema(schema).parquet(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return spark.read.parquet(out)


ALBUM = "album string, member string, state string, level double, peak double, seconds double, at timestamp"


def test_albums_come_out_when_all_has_settled(stateful, tmp_path):
    far = ("z", "t", "pending", None, None, None, at(100_000))
    parts = [
        [("a", "1", "pending", None, None, None, at(1)), ("a", "2", "pending", None, None, None, at(1)), ("a", "1", "done", -10.0, 0.5, 100.0, at(5)), ("b", "1", "done", -20.0, None, 10.0, at(6)), ("y", "t", "pending", None, None, None, at(300)), (None, "1", "done", None, None, 1.0, at(6))],
        [("a", "2", "done", -20.0, 0.9, 300.0, at(600)), ("b", "2", "pending", None, None, None, at(601)), ("a", "2", "done", -20.0, 0.9, 300.0, at(602)), ("q", "1", "done", 0.0, 1.0, 1.0, at(700))],
        [("b", "2", "failed", None, None, None, at(1300)), ("c", "1", "pending", None, None, None, at(1301)), ("c", "1", "gone", None, None, None, at(1302)), far],
    ]
    got = run(stateful, tmp_path, ALBUM, parts, keyed.settled_albums)
    found = sorted((r["album"], r["revision"], r["members"], r["good"]) for r in got.collect())
    assert found == [("", 1, 1, 0), ("a", 4, 2, 2), ("b", 1, 1, 1), ("b", 3, 2, 1), ("q", 1, 1, 1)]  # b again, as a member came late
    a = got.filter("album = 'a'").first()
    assert a["gain"] == pytest.approx(-18 - 10 * math.log10((100 * 10**-1 + 300 * 10**-2) / 400)) and a["peak"] == 0.9
    events = stateful.createDataFrame([r for p in parts for r in p], ALBUM)
    batch = {r["album"]: (r["members"], r["good"], None if r["gain"] is None else round(r["gain"], 9), r["peak"]) for r in keyed.settled_albums_batch(events).collect()}
    last = {r["album"]: (r["members"], r["good"], None if r["gain"] is None else round(r["gain"], 9), r["peak"]) for r in sorted(got.collect(), key=lambda r: r["revision"])}
    assert batch == last
    assert keyed.settled_albums_batch(events.limit(0)).count() == 0


PLAY = "listener string, instance string, title string, artist string, length double, playing boolean, at timestamp"


def test_scrobbles_come_out_once(stateful, tmp_path):
    play = lambda who, instance, playing, when, length=100.0, title="t": (who, instance, title, "a", length, playing, at(when))
    parts = [
        [play("u", "1", True, 0), play("u", "1", False, 30), play("v", "1", True, 0, 600.0), play("w", "1", True, 0, 30.0), play("x", "1", True, 0, 100.0, " ")],
        [play("u", "1", True, 100), play("u", "1", False, 115), play("y", "1", True, 110, 100.0), play("y", "2", True, 150)],
        [play("u", "1", True, 400), play("u", "1", True, 410), play("u", "2", True, 500), play("z", "9", False, 5000)],
    ]
    got = run(stateful, tmp_path, PLAY, parts, keyed.scrobbled)
    # u has heard 30 + 15 + 5 of 50 by its third stretch; v by a timer after four minutes; y's first is cut off by its second
    assert sorted((r["listener"], r["instance"], r["started"]) for r in got.collect()) == [("u", "1", at(0)), ("u", "2", at(500)), ("v", "1", at(0)), ("y", "2", at(150))]


def test_picks_of_a_stream_are_labelled_as_those_of_a_table(stateful, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("uvw"), rng.choice("abcdefgh"), at(i), None if rng.random() < 0.6 else round(rng.random(), 3)) for i in range(300)]
    schema = "listener string, item string, at timestamp, reward double"
    got = run(stateful, tmp_path, schema, [rows[:100], rows[100:200], rows[200:]], lambda s: keyed.labelled_picks(s, 3))
    df = stateful.createDataFrame(rows, schema)
    want = mixing.first_feedback(df.filter("reward IS NULL").drop("reward"), df.filter("reward IS NOT NULL"), "listener", "item", "at", 3)
    shown = lambda d: sorted(map(tuple, d.select("listener", "item", "picked_at", "label_at", "reward").collect()))
    assert shown(got) == shown(want) and got.count() > 30
    assert got.filter(F.col("label_at") < F.col("picked_at")).count() == 0
