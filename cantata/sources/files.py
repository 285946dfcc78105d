"""Readers and writers: folders, snapshots, NDJSON, CSV and M3U playlists, CUE sheets, lyrics, listings, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUDIO = ("flac", "mp3", "m4a", "ogg", "opus", "wav", "aac")


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO, with_content: bool = False) -> DataFrame:
    """path, modified, size (and content) of the files below a folder that have one of the extensions."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *["content"] * with_content)


def folder_statistics(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def incremental(listed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, modified) listed and known: what must be read again, and what is gone."""
    same = [listed["path"] == known["path"], listed["modified"] == known["modified"]]
    return listed.join(known, same, "left_anti"), known.join(listed, "path", "left_anti").select("path")


def write_snapshot(rows: DataFrame, path: str, current_version: int) -> None:
    """path and modified (-1 for rows of an older version) as tab-separated values."""
    modified = F.when(F.col("version") < current_version, -1).otherwise(F.col("modified"))
    rows.select("path", modified.alias("modified")).write.mode("errorifexists").csv(path, sep="\t", escape='"')


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", escape='"', schema="path string, modified long")


def read_counted_json(spark: SparkSession, path: str, schema: str, expected: int) -> DataFrame:
    """NDJSON rows; a file of another number of rows was cut off, and reading it fails."""
    rows = spark.read.schema(schema).json(path)
    found = rows.count()
    if found != expected:
        raise ValueError(f"{found} rows instead of {expected}")
    return rows


# The headers of each field, the one that counts first.
ALIASES = {
    "title": ("track name", "track", "name", "title"),
    "artist": ("artist name(s)", "artist name", "artist", "artists"),
    "album": ("album name", "album"),
    "isrc": ("isrc",),
    "id": ("track uri", "spotify - id", "spotify id", "spotify_id", "id", "uri"),
}
ID_PREFIX = "spotify:track:"


def read_playlist_csv(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """The fields of a CSV playlist, each from the first header of its names that the file has; quotes are doubled.

    Absent fields and blanks are null. Rows without an id are left out unless they have a title and an artist.
    """
    raw = spark.read.csv(path, header=True, escape='"', encoding="UTF-8")
    by_name = {c.strip().lstrip("\ufeff").lower(): c for c in raw.columns}

    def field(names: tuple[str, ...]):
        header = next((by_name[n] for n in names if n in by_name), None)
        return F.nullif(F.trim(F.col("`" + header.replace("`", "``") + "`")), F.lit("")) if header else F.lit(None).cast("string")

    rows = raw.select(*[field(names).alias(name) for name, names in aliases.items()])
    if "id" in aliases:
        rows = rows.withColumn("id", F.nullif(F.regexp_replace("id", f"^{ID_PREFIX}", ""), F.lit("")))
        rows = rows.filter("id IS NOT NULL OR (title IS NOT NULL AND artist IS NOT NULL)")
    return rows


def _lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line of each line of whole texts."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^﻿", "")
    return texts.select(key, F.posexplode(F.split(clean, r"\r\n|\r|\n")).alias("pos", "line"))


def m3u_entries(playlists: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, place, location, seconds, label: an EXTINF line tells of the next location line, others are skipped."""
    lines = _lines(playlists, key, text).withColumn("line", F.trim("line")).filter("line <> ''")
    info = F.when(F.col("line").startswith("#EXTINF:"), F.col("line"))
    shown = (~F.col("line").startswith("#")).cast("int")
    order = Window.partitionBy(key).orderBy("pos")
    # what follows the location before: locations number the spans, an EXTINF belongs to the span that its location ends
    lines = lines.withColumn("span", F.coalesce(F.sum(shown).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy(key, "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumn("info", F.last(info, ignorenulls=True).over(w)).filter(~F.col("line").startswith("#"))
    return found.select(
        key,
        (F.col("span") + 1).cast("int").alias("place"),
        F.col("line").alias("location"),
        F.regexp_extract("info", r"^#EXTINF:\s*(-?\d+)", 1).try_cast("int").alias("seconds"),
        F.nullif(F.trim(F.regexp_extract("info", r"^#EXTINF:[^,]*,(.*)$", 1)), F.lit("")).alias("label"),
    )


def write_m3u(entries: DataFrame, path: str) -> None:
    """One playlist (place, location, seconds, label) as a text file."""
    line = F.concat_ws("\n", F.concat(F.lit("#EXTINF:"), F.coalesce("seconds", F.lit(-1)), F.lit(","), F.coalesce("label", F.lit(""))), F.col("location"))
    body = entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda e: e["l"]), "\n").alias("all"))
    body.select(F.concat(F.lit("#EXTM3U\n"), "all")).write.mode("errorifexists").text(path)


def cue_tracks(sheets: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, number, title, performer, file, start, seconds (until the next track of the file, null for the last)."""
    lines = _lines(sheets, key, text).withColumn("line", F.trim("line"))
    of = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    number, file = of(r"^TRACK\s+(\d+)\s+AUDIO").cast("int"), of(r'^FILE\s+"?(.*?)"?\s+\w+$')
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("number", F.last(number, ignorenulls=True).over(order)).withColumn("file", F.last(file, ignorenulls=True).over(order)).filter("number IS NOT NULL")
    clock = r"^INDEX\s+01\s+(\d+):(\d+):(\d+)"
    start = F.when(F.col("line").rlike(clock), F.regexp_extract("line", clock, 1).cast("int") * 60 + F.regexp_extract("line", clock, 2).cast("int") + F.regexp_extract("line", clock, 3).cast("int") / 75)
    tracks = lines.groupBy(key, "file", "number").agg(
        F.max(of(r'^TITLE\s+"?(.*?)"?$')).alias("title"), F.max(of(r'^PERFORMER\s+"?(.*?)"?$')).alias("performer"), F.max(start).alias("start")
    )
    after = F.lead("start").over(Window.partitionBy(key, "file").orderBy("number"))
    return tracks.withColumn("seconds", after - F.col("start")).select(key, "number", "title", "performer", "file", "start", "seconds")


def lyric_lines(texts: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, time_ms, end_ms (the next line's time), text of LRC lyrics; [offset:] shifts, a line may have several stamps."""
    lines = _lines(texts, key, text)
    stamp = r"\[(\d+):(\d{1,2}(?:[.:]\d{1,3})?)\]"
    offset = F.max(F.regexp_extract("line", r"^\[offset:\s*([+-]?\d+)\]", 1).try_cast("int")).over(Window.partitionBy(key))
    lines = lines.withColumn("offset", F.coalesce(offset, F.lit(0)))
    stamps = F.regexp_extract_all("line", F.lit("(" + stamp + ")"), 1)
    each = lines.select(key, "pos", "offset", F.explode(stamps).alias("stamp"), F.trim(F.regexp_replace("line", stamp, "")).alias("text"))
    seconds = F.regexp_replace(F.regexp_extract("stamp", stamp, 2), ":", ".").cast("double")
    at = F.greatest(F.lit(0), F.round(F.regexp_extract("stamp", stamp, 1).cast("int") * 60000 + seconds * 1000 - F.col("offset")).cast("long"))
    each = each.withColumn("time_ms", at)
    return each.withColumn("end_ms", F.lead("time_ms").over(Window.partitionBy(key).orderBy("time_ms", "pos"))).select(key, "time_ms", "end_ms", "text")


def listing_links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """key and href of every link of an HTML index."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    return pages.select(key, F.explode(F.array_distinct(hrefs)).alias("href"))


def write_backup(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def read_backup(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
