"""What keeps queries within their limits on larger tables, and that it changes no result."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cantata import registry
from cantata.functions import scores as sc
from cantata.operators import item_vectors, joins, mixes, mixing, parts
from cantata.operators import ranking as rk
from cantata.operators import search_index
from cantata.sources import markup


def test_nearest_is_the_cosine_of_all_pairs_however_dealt(spark):
    rng = random.Random(3)
    some = [[rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(40)]
    rows = [(i, some[i % 40]) for i in range(160)] + [(200, [0.0] * 4), (201, None), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, 2.0]), (204, [2.0, 1.0]), (205, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = df.filter("id % 7 = 0 OR id > 200").withColumnRenamed("id", "q")
    pairs = asked.select("q", F.col("v").alias("a")).crossJoin(df).filter("q <> id").select("q", "id", F.round(rk.cosine(F.col("a"), F.col("v")) * 10000).cast("long").alias("sim"))
    want = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).filter("rn <= 5").drop("rn")
    want = sorted(map(tuple, want.collect()), key=repr)
    for sizes in ({}, {"of_asked": 7, "of_rows": 9}):
        got = rk.nearest(asked, "q", df, "id", "v", 5, **sizes)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_cosines_near_a_half_are_added_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 64)), rng.normal(size=(50, 64))
    exact = np.array([[rk._in_order(x[None], y[None])[0] / np.sqrt(rk._in_order(x[None], x[None])[0] * rk._in_order(y[None], y[None])[0]) for y in b] for x in a])
    for scale in (10_000, 10**11):  # of the larger scale every one is near a half
        assert (rk.rounded_cosines(a, b, scale) == rk._rounded(exact * scale)).all()


def test_posting_lists_are_made_in_tasks_and_have_every_gram(spark, tmp_path, monkeypatch):
    texts = ["Abcabc", "", "ab", None, "xyz" * 50, "İstanbul abc", "a\U0001f600b\U0001f600", "漢字かな", "\x00\x00\x00"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lower = {r.id: r.low for r in docs.selectExpr("id", "lower(coalesce(text, '')) AS low").collect()}
    want = sorted({(low[k : k + 3], i) for i, low in lower.items() for k in range(len(low) - 2)})
    lists = search_index._postings(docs, "id", F.col("text"), 0, 64)
    assert sorted((r.gram, i) for r in lists.collect() for i in r.ids) == want
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no row for each gram of each document
    monkeypatch.setattr(search_index, "LETTERS", 10)
    pieces = [b.to_pylist() for i, t in lower.items() for b in search_index._lists(np.array([i, i + 100]), [t, t])]
    assert sorted({(r["gram"], i) for b in pieces for r in b for i in r["ids"] if i < 100}) == want


def test_lyrics_are_scored_by_texts_made_before_they_meet(spark):
    rows = [("Song (Live)", "A feat. B", 200, "song", "a", 205), (" - ", None, None, "x", "B", 1), ("Ring", "Brand", 0, "ring two", "BRAND", 9), (None, "", 50, "", None, 70)]
    df = spark.createDataFrame(rows, "a_title string, a_artist string, a_duration int, b_title string, b_artist string, b_duration int")
    a, b = ({f: F.col(f"{s}_{f}") for f in ("title", "artist", "duration")} for s in ("a", "b"))
    want = df.select(sc.lyrics_score(a, b)).collect()
    made = df.withColumns({f"{s}_{f}": c for s, side in (("a", a), ("b", b)) for f, c in sc.lyrics_plain(side).items()})
    assert made.select(sc.lyrics_score(a, b, plain=True)).collect() == want
    plan = registry.QUERIES["lyrics_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "regexp_replace" not in top  # no pair's text is worked out anew


def test_xml_is_read_on_all_cores(spark):
    one = spark.createDataFrame([(i, f"<tt><body><div><p begin='{i}s'>x</p></div></body></tt>") for i in range(50)], "id long, xml string").coalesce(1)
    lines = markup.ttml_lines(one, "xml")
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r.id, r.time_ms) for r in lines.collect()) == [(i, i * 1000) for i in range(50)]
    assert markup.webdav_entries(one, "xml").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_features_of_outcomes_are_made_once(spark):
    names = spark.createDataFrame([(["a", "foobar", ""],)], "names array<string>")
    both = names.select(mixing.hashed_features(F.col("names")).alias("all"), F.array(*[mixing.hashed_feature(F.col("names")[i]) for i in range(3)]).alias("each")).first()
    assert both["all"] == both["each"]
    plan = registry.QUERIES["preferences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_division_moves_both_sides_once_in_parts_of_their_rows(spark):
    needed = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (3, None), (4, 9), (None, 1)], "g int, i int")
    present = spark.createDataFrame([(1, 1), (1, 2), (1, 7), (2, 1), (3, None), (5, 5), (None, 1)], "g int, i int")
    groups = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "g int")
    for n in (None, 3):
        assert sorted(r.g for r in joins.has_all(groups, "g", needed, present, n).collect()) == [1, 2]
    plan = joins.has_all(groups, "g", needed, present, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "hashpartitioning(g" in plan


def test_albums_come_in_parts_of_their_rows(spark, monkeypatch):
    monkeypatch.setattr(parts, "parts_for", lambda df, rows=0: 37)
    for name in ("completeness", "item_pairs", "division_all"):
        assert ", 37)" in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_rows(spark):
    told = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts.parts_for(spark.range(10)) == told and parts.parts_for(spark.range(1000), 10) == 100


def test_steps_add_up_in_the_order_of_the_pairs():
    rng = np.random.default_rng(1)
    c, t, y, r = rng.integers(0, 9, 600), rng.integers(0, 7, 600), (rng.random(600) > 0.2).astype(float), rng.random(600)
    start, chances = rng.random((9, 4)), np.cumsum(rng.random(7))
    inputs, outputs, x, o = start.copy(), np.zeros((7, 4)), start.copy(), np.zeros((7, 4))
    item_vectors.train(c, t, y, r, inputs, outputs, chances, np.random.default_rng(2), 2, 100)
    again = np.random.default_rng(2)
    for k in range(0, 600, 100):
        s = slice(k, k + 100)
        drawn = np.searchsorted(chances, again.random((100, 2)) * chances[-1], side="right").clip(max=6)
        to = np.concatenate([t[s, None], drawn], axis=1)
        used = np.concatenate([np.ones((100, 1), bool), (drawn != t[s, None]) & (y[s, None] > 0)], axis=1)
        a, b = x[c[s]], o[to]
        pull = (np.concatenate([y[s, None], np.zeros((100, 2))], axis=1) - 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", a, b)))) * r[s, None] * used
        np.add.at(o, to, pull[:, :, None] * a[:, None, :])
        np.add.at(x, c[s], np.einsum("nk,nkd->nd", pull, b))
    assert (inputs == x).all() and (outputs == o).all()


def test_pairs_of_a_session_are_made_without_a_join(spark):
    plan = registry.QUERIES["item_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_songs_of_a_mix_are_made_once(spark):
    pool = spark.range(60).selectExpr("0 AS who", "id AS song", "CAST(id % 7 AS STRING) AS artist", "array('x') AS families", "1.0D AS plays", "1.0D AS __max", "true AS mostly", "'genre' AS kind", "'x' AS key", "1 AS rank", "1.0D AS lead", "true AS core", "true AS shuffled")
    found = mixes.candidates(pool, "2024-01-01")
    assert found.count() == 60
    assert "first(" not in found._jdf.queryExecution().optimizedPlan().toString()
