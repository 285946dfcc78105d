"""Orders, albums, resolution, mixing and upkeep on small literal tables: unknowns, ties, empties and rules' edges."""

import datetime

import pytest
from pyspark.sql import functions as F

from cantata.functions import scores
from cantata.functions import text as fn
from cantata.operators import albums, filters, maintenance, mixing, ordering, ranking, resolution


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("2024", 20240101), ("2024-05", 20240501), ("2024-05-07", 20240507), (" 2024-05-07T10:00:00 ", 20240507), ("2024-02-30", 0), ("2023-02-29", 0), ("2024-13", 0), ("0000", 0), ("2024-05-07Tx", 0), ("24", 0), ("", 0), (None, 0)],
)
def test_partial_dates(spark, raw, key):
    assert one(spark, ordering.partial_date_key(F.lit(raw).cast("string"))) == key


def test_unknown_sizes_are_last_both_ways(spark):
    fields = dict.fromkeys(("name", "artist", "album", "added", "release", "genre", "source", "key"), "key") | {"size": "size"}
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "key int, size int")
    for mode, order in (("size-asc", [2, 3, 1]), ("size-desc", [3, 2, 1]), ("no such mode", [3, 2, 1])):
        assert [r["key"] for r in ordering.page(df, ordering.sort_terms(mode, fields), 9).collect()] == order
    assert ordering.page(df.limit(0), ordering.sort_terms("a-z", fields), 9).count() == 0


def test_folder_is_in_album_order_only_if_all_is_numbered(spark):
    rows = [("a", "X ", 1, 2, "B"), ("a", "x", None, 1, "C"), ("b", "x", 1, None, "d"), ("b", "x", 1, 3, "e"), ("c", "x", 1, 1, "f"), ("c", "y", 1, 2, "g"), (None, "x", 2, 1, "h")]
    got = ordering.folder_order(spark.createDataFrame(rows, "folder string, album string, disc int, track int, name string"), "folder", "album", "disc", "track", "name")
    assert values(got, "by_name", "by_disc", "by_track") == [("b", 1, 2), ("c", 0, 1), ("d", 0, 0), ("e", 0, 0), ("f", 0, 0), ("g", 0, 0), ("h", 2, 1)]


def test_seeds_are_of_other_artists_first_and_turn(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a")], "n int, artist string")
    pick = lambda turn: [r["n"] for r in ordering.distinct_first(df, "artist", "n", ["n"], 4, turn).orderBy("pick").collect()]
    assert pick(0) == [1, 3, 4, 2]
    assert pick(1) == [5, 3, 4, 1]  # from the fifth row on, then round
    assert ordering.distinct_first(df.limit(0), "artist", "n", ["n"], 4).count() == 0


def test_ranges_and_strategies(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, n int")
    assert values(ordering.between_items(df, "id", ["n", "id"], 5, 1), "id") == [(1,), (2,), (4,), (5,), (7,)]
    assert ordering.between_items(df, "id", ["n", "id"], 5, 99).count() == 0
    assert values(ordering.between_items(df, "id", ["n", "id"], 5, 5), "id") == [(5,)]
    assert values(ordering.first_with_rows([df.filter("id > 99"), df.filter("id > 8"), df]), "id", "strategy") == [(9, 1)]
    assert ordering.first_with_rows([df.filter("id > 99")]).count() == 0
    assert values(ordering.first_wins([df.filter("n = 1"), df], ["n"], "id"), "n", "id", "part") == [(0, 0, 1), (1, 1, 0), (2, 2, 1)]


@pytest.mark.parametrize(("known", "has", "missing"), [(True, 0, True), (True, None, True), (True, 1, False), (False, 0, False), (None, 0, False)])
def test_only_what_is_known_is_missing(spark, known, has, missing):
    assert one(spark, filters.confirmed_missing(F.lit(known).cast("boolean"), F.lit(has).cast("int"))) is missing


@pytest.mark.parametrize(("tag", "path", "found"), [(" Vorbis", None, True), ("ec-3", "a.OGG", True), (None, "a.flac", False), ("", "ogg", False)])
def test_formats_go_by_several_names(spark, tag, path, found):
    assert one(spark, filters.has_format(" OGG", F.lit(tag).cast("string"), F.lit(path).cast("string"))) is found


def test_gaps_between_lines(spark):
    lines = [(1, 5, 7, "a"), (2, 8, None, "b"), (3, 9, None, " "), (4, 20, 30, "c"), (5, 21, 22, "d"), (6, 31, 2, "e"), (7, 40, None, "f"), (8, 50, None, "")]
    df = spark.createDataFrame([("s", *x) for x in lines], "song string, n int, at int, until int, text string")
    got = albums.with_gaps(df, "song", "at", "until", "text", ["at", "n"], 3)
    # before the first line; after the blank one; not between d and e, as c still lasts; nor before f, as e's end is none
    assert values(got.filter("text = ''"), "at", "until") == [(0, 5), (9, 20)]
    assert got.count() == 8
    assert albums.with_gaps(df.limit(0), "song", "at", "until", "text", ["at", "n"], 3).count() == 0


def test_tags_majorities_and_credits(spark):
    tags = spark.createDataFrame([(1, " Rock", 3, 0), (1, "rock", 9, 1), (1, "Pop", 3, 2), (1, "", 99, 3), (2, None, 1, 0)], "song int, name string, votes int, place int")
    assert values(albums.leading_tag(tags, "song", "name", "votes", "place"), "song", "tag") == [(1, "Rock")]
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", None), (4, "b", None), (5, None, None)], "song int, artist string, kind string")
    assert values(albums.fill_by_majority(rows, "artist", "kind"), "song", "kind") == [(1, "x"), (2, "y"), (3, "x"), (4, None), (5, None)]
    tracks = spark.createDataFrame([("l", 1, "A & B"), ("l", 2, "b feat. C"), ("m", 3, "A")], "album string, track int, artist string")
    assert values(albums.shared_credits(tracks, "album", "track", fn.credits(F.col("artist"))), "album", "credit") == [("l", "b")]


def test_last_metric(spark):
    log = F.lit("I: -70.0 LUFS\nPeak:\nI:  -14.5 LUFS\nXI: 3")
    assert one(spark, albums.last_metric(log, "I")) == -14.5
    assert one(spark, albums.last_metric(log, "Peak")) is None
    assert one(spark, albums.last_metric(F.lit(None).cast("string"), "I")) is None


@pytest.mark.parametrize(("raw", "name"), [("Đorđe Balašević", "djordje balasevic"), ("Straße", "strasse"), ("Sigur Rós", "sigur ros"), ("AC/DC", "ac dc"), ("Guns N' Roses", "guns n roses"), ("宇多田ヒカル", "宇多田ヒカル"), (None, "")])
def test_loose_names(spark, raw, name):
    assert one(spark, scores.loose_name(F.lit(raw).cast("string"))) == name


def test_paths_of_one_file(spark):
    rows = spark.createDataFrame([(1, "/Music/A b/x.flac"), (2, "file:///music/a%20b/x.flac"), (3, "\\music\\a b\\x.flac"), (4, "/music/a b/x.opus"), (5, None), (6, "/music/100%/x.flac")], "id int, path string")
    wanted = spark.createDataFrame([("/music/a b/X.flac",), (None,), ("/music/100%/x.flac",)], "wanted string")
    assert values(resolution.physical_matches(rows, "id", "path", wanted, "wanted"), "id") == [(1,), (2,), (3,), (6,)]


def test_cascade_takes_the_first_key_that_finds_something(spark):
    known = spark.createDataFrame([(1, "/a", "I1"), (2, "/b", "I2"), (3, "/b", None)], "id int, path string, isrc string")
    rows = spark.createDataFrame([(1, "/b", "I1"), (2, "/z", "I1"), (3, "", "  "), (4, None, None)], "row int, p string, i string")
    got = resolution.cascade(rows, [("path", F.col("p"), known, F.col("path"), "id"), ("isrc", F.col("i"), known, F.col("isrc"), "id")], "found")
    assert values(got, "row", "found", "found_by") == [(1, 2, "path"), (2, 1, "isrc"), (3, None, ""), (4, None, "")]


@pytest.mark.parametrize(
    ("marks", "exact", "found"),
    [([90, 81], False, [(1, 90)]), ([90, 82], False, []), ([96, 95], False, [(1, 96)]), ([84], False, []), ([20, 20], True, [(1, 20)]), ([95, 95], False, [(1, 95)]), ([94, 94], False, [])],
)
def test_close_runners_up_make_a_match_unsure(spark, marks, exact, found):
    pairs = spark.createDataFrame([(7, i + 1, m) for i, m in enumerate(marks)], "asked int, candidate int, mark int")
    assert values(resolution.surest(pairs, ["asked"], "candidate", F.col("mark"), F.lit(exact)), "candidate", "score") == found


def test_replacement_score_by_hand(spark):
    side = lambda **f: {k: F.lit(f.get(k)).cast("int" if k in ("duration", "track", "disc", "year") else "string") for k in ("isrc", "title", "artist", "album", "duration", "track", "disc", "year")}
    asked = side(isrc="US-RC1-76-07839", title="Song", artist="Band", album="LP", duration=200, track=1, disc=1, year=1999)
    assert one(spark, scores.replacement_score(asked, side(isrc="usrc17607839", title="song", artist="BAND", album="lp", duration=202, track=1, disc=1, year=1999))) == 140 + 45 + 30 + 12 + 20 + 6 + 4 + 4
    assert one(spark, scores.replacement_score(asked, side(isrc="GB1", title="Song (Live)", artist="Other", duration=230))) == -120 - 25 - 20 - 30 - 18
    assert one(spark, scores.replacement_score(side(), side())) == 45 + 30


def test_enrichment_score_by_hand(spark):
    side = lambda isrc, title, artist: {"isrc": F.lit(isrc).cast("string"), "title": F.lit(title).cast("string"), "artist": F.lit(artist).cast("string")}
    assert one(spark, scores.enrichment_score(side("x1", "A song!", "Band"), side("X1 ", "a song", "the band"))) == 140
    assert one(spark, scores.enrichment_score(side(None, "song", ""), side(None, "A Song", ""))) == 15
    assert one(spark, scores.enrichment_score(side(None, None, None), side(None, None, None))) == 0


def test_children_of_a_folder(spark):
    base = "https://h/dav/m/"
    urls = ["a.flac", "a.flac", "sub/", "sub/deep.flac", "b.flac?x=1", "%61.flac", "x%2Fy", "", ".."]
    rows = [(i, base + u) for i, u in enumerate(urls)] + [(90, "https://other/dav/m/a"), (91, "https://h/dav/c")]
    got = resolution.direct_children(spark.createDataFrame(rows, "n int, url string"), "url", base, "n")
    assert values(got, "name", "folder", "n") == [("a.flac", False, 5), ("sub", True, 2)]


def test_feedback_goes_to_the_last_pick_once(spark):
    picks = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "a", 5), ("u", "c", 6), ("v", "a", 1)], "who string, item string, at int")
    said = spark.createDataFrame([("u", "a", 3, 1.0), ("u", "a", 4, 0.0), ("u", "a", 7, 0.5), ("u", "b", 8, 1.0), ("u", "z", 9, 1.0)], "who string, item string, at int, reward double")
    labels = lambda keep: values(mixing.first_feedback(picks, said, "who", "item", "at", keep), "item", "picked_at", "label_at", "reward")
    assert labels(200) == [("a", 1, 3, 1.0), ("a", 5, 7, 0.5), ("b", 2, 8, 1.0)]
    assert labels(2) == [("a", 1, 3, 1.0), ("a", 5, 7, 0.5)]  # b, a and c would wait
    rows = [("u", "a", 1), ("u", "b", 3), ("u", "c", 5), ("u", "d", 7), (None, "a", 1)]
    picks = spark.createDataFrame(rows, "who string, item string, at int")
    said = spark.createDataFrame([("u", "b", 4, 1.0), ("u", "c", 6, 1.0), ("u", "d", 8, 1.0), ("u", "a", 9, 1.0), (None, "a", 2, 0.0)], "who string, item string, at int, reward double")
    assert labels(2) == [("a", 1, 2, 0.0), ("a", 1, 9, 1.0), ("b", 3, 4, 1.0), ("c", 5, 6, 1.0), ("d", 7, 8, 1.0)]  # what is labelled at once takes no room
    assert mixing.first_feedback(picks.limit(0), said.limit(0), "who", "item", "at").count() == 0


def test_scrobbles(spark):
    rows = [(1, "t", "a", 100, 60), (1, "t", "a", 51, 60), (2, "t", "a", 300, 600), (3, "t", "a", 30, 30), (4, " ", "a", 99, 60), (5, "t", "a", 239, 600), (6, "t", "a", 99, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "play int, title string, artist string, seconds int, duration int, at int")
    assert values(mixing.scrobbles(df, "play", "title", "artist", "seconds", "duration", "at"), "play", "heard", "started") == [(1, 151, 0), (2, 300, 2)]


def test_keys_and_tempos(spark):
    chroma = lambda tonic, profile: F.array(*[F.lit(profile[(p - tonic) % 12]) for p in range(12)])
    for tonic in (0, 5, 11):
        for major, profile in ((True, mixing.MAJOR_PROFILE), (False, mixing.MINOR_PROFILE)):
            got = one(spark, mixing.best_key(chroma(tonic, profile)))
            assert (got["tonic"], got["major"], round(got["strength"], 9)) == (tonic, major, 1.0)
    flat = one(spark, mixing.best_key(F.array(*[F.lit(1.0)] * 12)))
    assert (flat["tonic"], flat["major"], flat["strength"]) == (0, True, 0.0)
    assert one(spark, mixing.octaves(F.lit(60.0), F.lit(120.0))) == 0.0
    key = lambda a, am, b, bm: one(spark, mixing.keys_agree(F.lit(a), F.lit(am), F.lit(b), F.lit(bm)))
    assert key(0, True, 9, False) and key(0, True, 7, True) and key(0, True, 5, True)  # its relative minor, a fifth up and down
    assert not key(0, True, 2, True) and not key(0, True, 4, False)
    assert tuple(one(spark, mixing.combined_tempo(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(90.0), F.lit(0.5)))) == (90.0, 0.4)


def test_hints_and_holdouts(spark):
    user = spark.createDataFrame([(1,), (1,), (2,)], "song int")
    liked = spark.createDataFrame([(1, 0.5, 3), (1, 1.0, 20), (2, 1.0, 90), (3, 0.0, 1)], "song int, reward double, age int")
    got = mixing.hint_plays(user, liked, user.limit(0), user, "song", "reward", F.col("age"))
    assert values(got, "song", "plays") == [(1, 6.0 + 0.5 + 1.0 + 1.0), (2, 3.5)]
    held = lambda n: mixing.temporal_holdout(spark.range(n), F.col("id"), ["id"]).filter("tested").count()
    assert [held(n) for n in (0, 39, 40, 100)] == [0, 0, 10, 25]


def test_play_weights(spark):
    day = datetime.date(2024, 6, 30)
    rows = [(1, day, 1), (1, day - datetime.timedelta(14), 1), (1, day - datetime.timedelta(90), 4), (1, day - datetime.timedelta(365), 9), (2, day, 0)]
    got = mixing.play_weights(spark.createDataFrame(rows, "song int, day date, n int"), "song", "day", "n", day)
    assert values(got, "song", "season", "past") == [(1, 3, 4)]


def test_logistic_steps_for_all_groups_at_once(spark):
    rows = [("a", 1.0, 0.0, 1, 2.0), ("a", 1.0, 0.0, 0, 1.0), ("b", 0.0, 2.0, 0, 5.0), (None, 1.0, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, label int, w double")
    got = {(r["g"], r["feature"]): r["coefficient"] for r in ranking.logistic_with_prior(df, "g", ["x", "y"], "label", "w").collect()}
    assert got["a", "y"] == pytest.approx(1) and got["b", "x"] == pytest.approx(1)  # nothing tells against the prior
    chance = 1 / (1 + 2.718281828459045 ** -got["a", "x"])
    assert 3 * chance - 2 + 4 * (got["a", "x"] - 1) == pytest.approx(0, abs=1e-6)  # the gradient there is zero
    assert got[None, "x"] > 1 and got["b", "y"] < 1
    assert ranking.logistic_with_prior(df.limit(0), "g", ["x", "y"], "label", "w").count() == 0


def test_moves_and_merges(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, path string, t string")
    moves = spark.createDataFrame([("a", "b"), ("q", "c")], "old_path string, new_path string")
    got = maintenance.relink(table, "id", "path", moves, F.ascii("new_path") - 96)
    assert values(got, "id", "path", "t") == [(2, "b", "x"), (3, "c", "z")]
    updates = spark.createDataFrame([(10, "b", None), (11, "n", "z"), (12, "n", "")], "id int, path string, t string")
    merged = maintenance.merge_by_any_key(table, updates, [F.col("path"), F.col("t")], "id")
    assert values(merged, "id") == [(1,), (10,), (12,)]  # 11 replaces 3 before 12 replaces it
    old = spark.createDataFrame([(10, "c1", "p"), (11, None, "x")], "id int, code string, name string")
    new = spark.createDataFrame([(20, "c1", "x"), (21, "c2", "x"), (22, "\t", "y"), (23, None, "p")], "id int, code string, name string")
    both = lambda **more: values(maintenance.merge_by_any_key(old, new, [F.col("code")], "id", **more), "id")
    assert both() == [(11,), (20,), (21,), (22,), (23,)]
    assert both(fallback=F.col("name")) == [(11,), (20,), (21,), (22,), (23,)]  # names of rows with a code find nothing
    assert values(maintenance.merge_by_any_key(old, new.filter("id = 23"), [F.col("code")], "id", F.col("name")), "id") == [(11,), (23,)]
    assert values(maintenance.merge_by_any_key(old, new.filter("id < 22"), [F.col("code"), F.col("name")], "id"), "id") == [(21,)]  # 20 goes, what it replaced too


def test_what_is_unreadable_is_kept(spark):
    listed = spark.createDataFrame([("/a/1",), ("/ab/1",), ("/b/1",), ("/a/x/2",)], "path string")
    closed = spark.createDataFrame([("/a/",), (None,)], "prefix string")
    assert values(maintenance.unprotected(listed, listed.filter("path = '/b/1'"), "path", closed, "prefix"), "path") == [("/ab/1",)]


def test_state_of_one_row(spark):
    empty = spark.createDataFrame([], "id int, status string")
    assert values(maintenance.put_state(empty, id=1, status="on"), "id", "status") == [(1, "on")]


def test_versions_are_published_whole(spark, tmp_path):
    path = maintenance.publish_versioned(spark.range(3), str(tmp_path), 2)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        maintenance.publish_versioned(spark.range(4), str(tmp_path), 2)


def test_hash_is_the_known_one(spark):
    assert [one(spark, fn.fnv1a(F.lit(s))) for s in ("a", "foobar")] == [0xE40C292C, 0xBF9CF968]
