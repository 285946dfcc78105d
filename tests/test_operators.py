"""Operators on small literal tables: cases that the driver's tables don't hold."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata import registry
from cantata.functions import text as fn
from cantata.operators import catalogue, joins, listening, maintenance, ranking, windows
from cantata.sources import files
from cantata.streaming import listening as streams
from tests.differential import DATA


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def album(positions, total, disc=1, discs=1, title=None, off=0):
    return [(title or f"t{p}", p, total, disc, discs, off) for p in positions]


ALBUMS = {
    "complete": (album([1, 2, 3], 3), "complete", 3, 3),
    "gap": (album([1, 3], 3), "incomplete", 2, 3),
    "one-track-album": (album([1], 12), "incomplete", 1, 12),
    "duplicate-incomplete": (album([1, 1, 2], 3), "incomplete", 2, 3),
    "duplicate-complete": (album([1, 1, 2], 2), "complete", 2, 2),
    "multi-incomplete": (album([1, 2], 2, 1, 2) + album([1], 3, 2, 2), "incomplete", 3, 5),
    "multi-complete": (album([1, 2], 2, 1, 2) + album([1, 2, 3], 3, 2, 2), "complete", 5, 5),
    "disc-gap": (album([1, 2], 2, 1, 2), "incomplete", 2, None),
    "ambiguous-but-missing": (album([1], 10, 1, 2) + album([1], 10, 2, 2), "incomplete", 2, None),
    "ambiguous": (album([1], 2, 1, 2) + album([1], 2, 2, 2), "unknown", 2, None),
    "equal-discs": (album([1, 2], 2, 1, 2) + album([1, 2], 2, 2, 2), "unknown", 4, None),
    "conflicting-total": (album([1], 3) + album([2], 4), "unknown", 2, None),
    "missing-total": (album([1], None), "unknown", 1, None),
    "total-on-one-track": (album([1], None) + album([2], 2), "complete", 2, 2),
    "missing-number": (album([0, 1], 3), "unknown", 1, None),
    "out-of-range": (album([1, 4], 3), "unknown", 2, None),
    "offline": (album([1, 2, 3], 3, off=1), "unknown", 3, None),
    "conflicting-discs": (album([1], 2, 1, 1) + album([2], 2, 1, 2), "unknown", 2, None),
    "invalid-total": (album([1], -1), "unknown", 1, None),
    "invalid-disc-total": (album([1], 1, 1, -1), "unknown", 1, None),
    "missing-disc-number": (album([1], 1, 0, 2), "unknown", 1, None),
    "no-disc-number": (album([1], 2, 0, 1) + album([2], 2, 1, 1), "complete", 2, 2),
    "conflicting-position": (album([1], 2, title="a") + album([1, 2], 2), "unknown", 2, None),
}


def test_completeness_labels(spark):
    rows = [(name, *slot) for name, (slots, *_) in ALBUMS.items() for slot in slots]
    of = lambda rows: catalogue.completeness(spark.createDataFrame(rows, "album string, title string, track int, total int, disc int, discs int, off int"), "album", "track", "total", "disc", "discs", "title", "off")
    assert {r["album"]: (r["status"], r["present"], r["expected"]) for r in of(rows).collect()} == {k: v[1:] for k, v in ALBUMS.items()}
    filled = of([*rows, ("gap", "t2", 2, 3, 1, 1, 0)]).filter("status = 'incomplete'").collect()
    assert "gap" not in {r["album"] for r in filled}


def test_artist_credits(spark):
    for line, names in (
        ("One, Two; one & Three feat. TWO", ["One", "Two", "Three"]), ("One x Two", ["One", "Two"]), ("Malcolm X", ["Malcolm X"]), ("X", ["X"]), ("  ", []),
        ("One featured Two", ["One", "Two"]), ("One feature Two", ["One", "Two"]), ("Florence and the Machine", ["Florence and the Machine"]), ("AC/DC", ["AC/DC"]),
        ("One ft.", ["One"]), ("One with Two", ["One", "Two"]), ("Swift & Ftera", ["Swift", "Ftera"]),
    ):
        assert one(spark, fn.credits(F.lit(line))) == names
    for raw, plain in [("A Song (Live at X) featured Two", "a song featured two"), ("Up - 2011 Remastered", "up"), ("Up (2011) [Live]", "up 2011 live"), ("+ (feat. B)", "+"), ("", "")]:
        assert one(spark, fn.simplify_title(F.lit(raw))) == plain


def test_playlist_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Track,Track Name,Artist Name(s),Track URI\n7,"Song ""A""",Ann,spotify:track:x1\n8,,Bob,\n9,,,y2\n')
    rows = files.read_playlist_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["title"], r["artist"], r["album"], r["id"]) for r in rows] == [('Song "A"', "Ann", None, "x1"), (None, None, None, "y2")]


def test_ranks_and_running_sums_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[int(g)] if g < 2 else None, float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 300, 900), strict=True))]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r["id"]: (r["s"], r["stratum"]) for r in windows.strata(windows.running_sum(df, ["g"], F.col("v"), ["v", "id"], F.col("id"), "s"), "g", F.col("v"), ["v", "id"], 7).collect()}
    for g in ("a", "b", None):
        mine, total = sorted((v, i) for i, x, v in rows if x == g), 0
        sizes = [len(part) for part in np.array_split(np.arange(len(mine)), 7)]
        place = np.repeat(np.arange(1, 8), sizes)
        for at, (_, i) in enumerate(mine):
            total += i
            assert got[i] == (total, place[at])
    ranks = {r["id"]: r["rank"] for r in windows.average_rank(df, "v").collect()}
    values = np.array([v for _, _, v in rows])
    assert all(ranks[i] == (values < v).sum() + ((values == v).sum() + 1) / 2 for i, _, v in rows)


def test_scalar_functions(spark):
    s = F.lit
    assert one(spark, fn.lookup_text(s("  AbC "))) == "abc"
    assert one(spark, fn.optional_text(s(" Null "))) is None
    assert one(spark, fn.isrc(s("us-rc1-76-07839"))) == "USRC17607839"
    assert one(spark, fn.isrc_display(s("USRC17607839"))) == "US-RC1-76-07839"
    assert one(spark, fn.credits(s("Ann feat. Bob & ann, Cy x Di"))) == ["Ann", "Bob", "Cy", "Di"]
    assert one(spark, fn.primary_artist(s("Various Artists"), s("Bob, Cy"))) == "Bob"
    assert one(spark, fn.clock_seconds(s("1:02:03"))) == 3723
    assert one(spark, fn.release_year(s("2019-05-10"))) == 2019
    assert one(spark, fn.safe_file_name(s("a/b:c. "))) == "a_b_c"
    assert one(spark, fn.gtin_is_valid(s("4006381333931"))) is True
    assert one(spark, fn.gtin_is_valid(s("4006381333932"))) is False
    assert one(spark, fn.similarity(s("kitten"), s("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, fn.token_overlap(s("a b c"), s("B c d e"))) == 0.5
    assert sorted(["t10", "t9", "T1"], key=lambda x: one(spark, fn.natural_key(s(x)))) == ["T1", "t9", "t10"]


def test_joins(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 3)], "k int, at int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b"), (2, 9, "c")], "k int, at int, v string")
    assert values(joins.as_of(left, right, "k", "at", ["v"]).fillna("-"), "k", "at", "v") == [(1, 5, "a"), (1, 10, "b"), (2, 3, "-")]
    spans = spark.createDataFrame([(1, 0, 6, "x"), (1, 5, 20, "y"), (1, 10, 10, "empty")], "k int, a int, b int, name string")
    assert values(joins.stabbing(left, spans, "k", "at", "a", "b", 4), "at", "name") == [(5, "x"), (5, "y"), (10, "y")]
    paths = spark.createDataFrame([(1, "/m/album/song.flac"), (2, "/q/other.flac"), (3, "/z/same.flac")], "id int, path string")
    targets = spark.createDataFrame([(7, "/n/album/song.flac"), (8, "/n/else/song.flac"), (9, "/a/same.flac"), (10, "/b/same.flac")], "tid int, target string")
    assert values(joins.longest_tail(paths, "id", "path", targets, "tid", "target"), "id", "tid", "k") == [(1, 7, 2)]
    roots = spark.createDataFrame([("/m/",), ("/m/album/",)], "root string")
    assert values(joins.longest_prefix(paths, "id", "path", roots, "root"), "id", "root") == [(1, "/m/album/")]
    pairs = spark.createDataFrame([(1, 1, 90), (1, 2, 50), (2, 1, 90), (2, 2, 85), (3, 1, 10)], "r int, c int, s int")
    assert values(joins.scored_match(pairs, "r", "c", F.col("s"), 40, 20), "r", "c") == [(1, 1)]


def test_sessions_follow_the_latest_time(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, i, at(m)) for i, m in enumerate([0, 30, 10, 45, 76])], "k int, id int, ts timestamp")
    assert values(windows.sessions(rows, "k", "ts", [F.asc("id")], 1800), "id", "session") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]


def test_maintenance(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert values(maintenance.merge_excluding(table, updates, "k", spark.createDataFrame([(3,)], "k int")), "k", "v") == [(1, "a"), (2, "B")]
    assert values(maintenance.apply_delta(table, spark.createDataFrame([(1,)], "k int"), updates, "k"), "k", "v") == [(2, "B"), (3, "c")]
    assert values(maintenance.difference(table, updates, "k", "v"), "k", "change") == [(1, "removed"), (2, "changed"), (3, "added")]
    assert maintenance.same_rows(table, table) and not maintenance.same_rows(table, table.union(table))
    counts = spark.createDataFrame([("x", 2), ("y", 1)], "v string, n long")
    assert values(maintenance.signed_counts(counts, spark.createDataFrame([("y", -1), ("z", 1)], "v string, n long"), ["v"]), "v", "n") == [("x", 2), ("z", 1)]
    wider = maintenance.migrate(table, T.StructType([T.StructField("k", T.LongType()), T.StructField("new", T.StringType())]))
    assert wider.columns == ["k", "new"] and values(wider, "k") == [(1,), (2,)]
    listed, seen, closed = (spark.createDataFrame(r, s) for r, s in (([("/a/1",), ("/a/2",), ("/b/1",)], "path string"), ([("/a/1",)], "path string"), ([("/b/",)], "prefix string")))
    assert values(maintenance.unprotected(listed, seen, "path", closed, "prefix"), "path") == [("/a/2",)]


def test_greedy_selection_keeps_members_apart(spark):
    rows = [("g", i, "A" if i < 5 else f"B{i}", 100.0 - i) for i in range(12)]
    picked = ranking.greedy_diverse(spark.createDataFrame(rows, "g string, item int, m string, s double"), "g", "item", "m", "s", 8, 2).orderBy("place").collect()
    members = [r["m"] for r in picked]
    assert len(members) == 8 and members[0] == "A"
    assert all(a != b for a, b in zip(members, members[1:], strict=False))


def test_split_at_midnight(spark):
    spans = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 23, 59), datetime.datetime(2024, 1, 3, 0, 1))], "k int, a timestamp, b timestamp")
    assert [x[1] for x in values(listening.split_at_midnight(spans, "a", "b", ["k"]), "day", "seconds")] == [60, 86400, 60]


def test_playlists_cue_and_lyrics(spark, tmp_path):
    m3u = spark.createDataFrame([("p", "﻿#EXTM3U\r\n#EXTINF:12,Ann - One\r\n/m/one.flac\r\n\r\n/m/two.flac\n#EXTINF:-1,Late\n# note\n/m/three.flac")], "path string, value string")
    got = values(files.m3u_entries(m3u).fillna({"seconds": -9, "label": ""}), "place", "location", "seconds", "label")
    assert got == [(1, "/m/one.flac", 12, "Ann - One"), (2, "/m/two.flac", -9, ""), (3, "/m/three.flac", -1, "Late")]
    sheet = 'FILE "disc.flac" WAVE\n  TITLE "Album"\n  TRACK 01 AUDIO\n    TITLE "One"\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    TITLE "Two"\n    INDEX 00 01:00:00\n    INDEX 01 01:02:37\n'
    tracks = files.cue_tracks(spark.createDataFrame([("c", sheet)], "path string, value string")).orderBy("number").collect()
    assert [(r["title"], r["file"]) for r in tracks] == [("One", "disc.flac"), ("Two", "disc.flac")]
    assert tracks[0]["seconds"] == pytest.approx(62 + 37 / 75) and tracks[1]["seconds"] is None
    lrc = spark.createDataFrame([("l", "[offset:100]\n[00:01.50][00:09.00]again\n[00:05.00]mid")], "path string, value string")
    assert [(r["time_ms"], r["end_ms"], r["text"]) for r in files.lyric_lines(lrc).orderBy("time_ms").collect()] == [(1400, 4900, "again"), (4900, 8900, "mid"), (8900, None, "again")]
    (tmp_path / "list.csv").write_text('Track Name,Artist Name(s)\n"One ""1""",Ann\n,Bob\n')
    assert [tuple(r) for r in files.read_playlist_csv(spark, str(tmp_path / "list.csv")).collect()] == [('One "1"', "Ann", None, None, None)]  # a row without title and id is none
    (tmp_path / "music").mkdir()
    (tmp_path / "music" / "a.FLAC").write_bytes(b"abc")
    (tmp_path / "music" / "b.txt").write_bytes(b"abc")
    assert files.folder_statistics(files.list_files(spark, str(tmp_path / "music"))).first() == (1, 3)


def test_streamed_totals_equal_the_batch(spark, tmp_path):
    rows = [(i % 3, datetime.datetime(2024, 1, 1 + i // 10, i % 24), 1.0 + i) for i in range(30)]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    for k in range(3):
        frame.filter(F.pmod(F.hash("ts"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), frame.schema).select("user_id", F.to_date("ts").alias("day"), "value", F.lit(1).alias("plays"))
    write = streams.merge_into(str(tmp_path / "out"), ["user_id", "day"], ["value", "plays"])
    seen = []

    def batch(df, n):
        write(df, n)
        write(df, n)  # a batch that is tried again adds nothing
        seen.append(n)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = values(streams.totals(spark, str(tmp_path / "out"), max(seen)), "user_id", "day", "value", "plays")
    assert got == values(frame.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("plays")), "user_id", "day", "value", "plays")


def test_windowed_and_session_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, at), (1, at + datetime.timedelta(minutes=20)), (1, at + datetime.timedelta(hours=2)), (2, at)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.timed(streams.event_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp"))
    found = streams.session_totals(stream, "user_id").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    found.awaitTermination()
    assert values(spark.table("sessions"), "user_id", "n") == [(1, 1), (1, 2), (2, 1)]
