import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from cantata import registry
from cantata.operators import item_vectors as iv


def test_one_step_by_hand():
    rng = np.random.default_rng(1)
    inputs, outputs = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    x, o = inputs.copy(), outputs.copy()
    center, context, label, rate = np.array([0, 1, 0]), np.array([2, 0, 3]), np.array([1.0, 1.0, 0.0]), np.array([0.1, 0.2, 0.3])
    chances = np.cumsum([1.0, 2.0, 1.0, 4.0])
    drawn = np.searchsorted(chances, np.random.default_rng(9).random((3, 2)) * chances[-1], side="right")
    iv.train(center, context, label, rate, x, o, chances, np.random.default_rng(9), negatives=2)
    want_in, want_out = inputs.copy(), outputs.copy()
    for i in range(3):
        targets = [(context[i], label[i])] + [(t, 0.0) for t in drawn[i] if t != context[i] and label[i] > 0]
        for t, y in targets:  # all gradients are those of the start
            g = rate[i] * (y - 1 / (1 + math.exp(-sum(inputs[center[i]] * outputs[t]))))
            want_in[center[i]] += g * outputs[t]
            want_out[t] += g * inputs[center[i]]
    assert np.allclose(x, want_in) and np.allclose(o, want_out)


def planted(spark):
    rng, rows = random.Random(2), []
    for s in range(120):
        own = rng.choice([range(0, 6), range(10, 16)])
        for at in range(8):
            rows.append((s, at, rng.choice(own), "x" if own[0] else "y", 1.0))
        rows.append((s, 9, 50, "z", -1.0))
    return spark.createDataFrame(rows, "s int, at int, song int, artist string, w double")


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "part": 3000, "epochs": 20, "rate": 0.03}])
def test_songs_of_the_same_sessions_are_near(spark, sizes):
    placed = iv.checkpointed(iv.positions(planted(spark), ["s"], [F.col("at")], "song", F.col("w")))
    assert placed.filter("weight < 0").count() == 120
    pairs = iv.checkpointed(iv.token_pairs(placed, ["s"], "song", "artist"))
    assert pairs.filter("label = 0").count() > 0 and pairs.filter("label = 0 AND center <> 'i:50' AND context <> 'i:50'").count() == 0
    counts = placed.select(F.concat(F.lit("i:"), F.col("song")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    got = {r["token"]: np.array(r["vector"]) for r in iv.item_vectors(pairs, counts, **sizes).collect()}
    assert len(got) == 13 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    group = lambda t: int(t[2:]) // 10
    inside = [got[a] @ got[b] for a in got for b in got if a < b and group(a) == group(b)]
    across = [got[a] @ got[b] for a in got for b in got if a < b and {group(a), group(b)} == {0, 1}]
    assert np.mean(inside) > np.mean(across) + 0.5
    again = {r["token"]: np.array(r["vector"]) for r in iv.item_vectors(pairs.repartition(5), counts.repartition(3), **sizes).collect()}
    assert all(np.allclose(got[t], again[t], atol=1e-6) for t in got)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "center string, context string, label double, rate double")
    assert iv.item_vectors(none, spark.createDataFrame([], "token string, n long")).count() == 0
    alone = iv.item_vectors(none, spark.createDataFrame([("i:1", 2), ("i:2", 2)], "token string, n long")).collect()
    assert len(alone) == 2


def test_negatives_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for weights in (rng.random(110), rng.random(50_000) ** 9, np.array([1.0]), np.array([0.0, 1.0, 0.0, 3.0]), np.full(7, 1e-300)):
        sums = np.cumsum(weights)
        numbers = np.concatenate([rng.random(20_000), np.arange(4096) / 4096, [np.nextafter(1.0, 0)]])
        want = np.searchsorted(sums, numbers * sums[-1], side="right").clip(max=len(sums) - 1)
        assert (iv._chooser(sums)(numbers) == want).all()


def test_pairs_are_packed_once_in_order(monkeypatch):
    monkeypatch.setattr(iv, "_CHUNK", 4)
    rng = random.Random(4)
    rows = [(rng.choice("abcx"), rng.choice("defx"), float(rng.random() < 0.7), rng.random()) for _ in range(60)]
    key = {c: pa.array([k] * 60, pa.int32()) for c, k in (("a", 1), ("b", 2), ("part", 3))}
    pairs = pa.table(key | {c: [r[i] for r in rows] for i, c in enumerate(("center", "context", "label", "rate"))})
    tokens = pa.table({"side": [1, 0, 1, 0, 0, 1], "token": ["f", "c", "d", "a", "b", "e"]})
    packed = iv._pack(pairs, tokens)
    known = sorted(("abc".index(c), "def".index(t), y, r) for c, t, y, r in rows if c != "x" and t != "x")
    assert packed["nth"].to_pylist() == list(range(-(-len(known) // 4))) and set(packed["a"].to_pylist()) == {1}
    got = zip(*[np.frombuffer(b"".join(packed[c].to_pylist()), kind).tolist() for c, kind in iv._KINDS.items()], strict=True)
    assert list(got) == known
    nothing_known = iv._pack(pairs, tokens.set_column(1, "token", pa.array(list("uvwxyz"))).filter(pa.compute.not_equal(pa.array(list("uvwxyz")), "x")))
    assert len(nothing_known) == 1 and nothing_known["center"][0].as_py() == b""  # it counts among the parts, with one vote
    assert len(iv._pack(pairs, tokens.slice(0, 0))) == len(iv._pack(pairs.slice(0, 0), tokens)) == 0


def test_passes_move_packed_pairs(spark, monkeypatch):
    """The pairs' rows are dealt once; a pass has a task for each part, however few bytes it is."""
    met, plans = iv._met, []

    def seen(left, right, key, groups, *rest):
        out = met(left, right, key, groups, *rest)
        plans.append((left.columns, out.rdd.getNumPartitions(), groups))
        return out

    monkeypatch.setattr(iv, "_met", seen)
    pairs = iv.checkpointed(iv.token_pairs(iv.positions(planted(spark), ["s"], [F.col("at")], "song", F.col("w")), ["s"], "song"))
    counts = pairs.groupBy(F.col("center").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    iv.item_vectors(pairs, counts, part=1000, epochs=2).count()
    assert len(plans) == 3 and plans[0][2] > 1 and all(n >= groups for _, n, groups in plans)
    assert [("nth" in columns) for columns, _, _ in plans] == [False, True, True]


def test_pairs_by_hand_without_interpreted_functions(spark):
    plays = spark.createDataFrame([(1, 0, 1, "x", 1.0), (1, 1, None, "y", -1.0), (1, 2, 2, None, 1.0), (2, 0, 3, "z", -1.0)], "s int, at int, song int, artist string, w double")
    placed = iv.positions(plays, ["s"], [F.col("at")], "song", F.col("w"))
    pairs = iv.token_pairs(placed, ["s"], "song", "artist")
    together = [("i:1", "a:x"), ("a:x", "i:1"), ("i:1", "i:2"), ("i:2", "i:1"), ("a:x", "i:2"), ("i:2", "a:x")]
    apart = [("a:y", t) for t in ("i:1", "a:x", "i:2")]  # the skip has no song: its artist stands for it
    want = [(*p, 1.0, 1.0) for p in together] + [(*q, 0.0, 0.5) for p in apart for q in (p, p[::-1])]
    assert sorted(tuple(r) for r in pairs.select("center", "context", "label", "rate").collect()) == sorted(want)
    assert "lambda" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    songs = iv.token_pairs(placed, ["s"], "song").select("center", "context", "label").collect()
    assert sorted(map(tuple, songs)) == [("i:1", "i:2", 1.0), ("i:2", "i:1", 1.0)]


def test_every_song_that_is_played_twice_has_a_vector(spark, tmp_path):
    """3,100 songs and 310 artists, more than the 3,000 tokens that were kept before."""
    song = F.concat(F.lit('{"k": '), (F.col("id") % 3100).cast("string"), F.lit("}"))
    plays = spark.range(6200).select(F.col("id").alias("event_id"), F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(50.0).alias("value"), song.alias("props"))
    once = plays.limit(1).withColumn("props", F.lit('{"k": 90000}'))
    plays.union(once).write.parquet(str(tmp_path / "events.parquet"))
    got = [r["token"] for r in registry.QUERIES["item2vec"](spark, str(tmp_path)).select("token").collect()]
    assert sorted(got) == sorted([f"i:{k}" for k in range(3100)] + [f"a:{k}" for k in range(310)])
