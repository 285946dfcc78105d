"""Nested XML as rows: timed lyrics and listings of folders, by Spark's own XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.operators.parts import spread

_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_text"}
_SPAN = "struct<_text: string, _begin: string, _end: string, _dur: string, _role: string"
_LINE = f"array<{_SPAN}, _agent: string, span: array<{_SPAN}, span: array<{_SPAN}>>>>>>"
_DIV = f"array<struct<_begin: string, _end: string, _agent: string, p: {_LINE}>>"
_TIMED = f"struct<body: struct<_begin: string, _end: string, div: {_DIV}>>"
_STATUS = "struct<_text: string, status: string, prop: struct<displayname: string, getcontentlength: string, getlastmodified: string, resourcetype: struct<collection: string>>>"
_LISTING = f"struct<response: array<struct<href: string, propstat: array<{_STATUS}>>>>"


def time_millis(c: Column) -> Column:
    """A time of timed text in milliseconds: h:m:s.f, m:s.f, or a number with h, m, s or ms. Null for anything else."""
    clock = lambda i: F.regexp_extract(c, r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$", i)
    number, unit = (F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(h|ms|m|s|)$", i) for i in (1, 2))
    clocked = F.coalesce(clock(1).try_cast("double"), F.lit(0.0)) * 3600 + clock(2).try_cast("double") * 60 + clock(3).try_cast("double")
    seconds = number.try_cast("double") * F.when(unit == "h", 3600.0).when(unit == "m", 60.0).when(unit == "ms", 0.001).otherwise(1.0)
    return F.round(F.coalesce(clocked, seconds) * 1000).cast("long")


def ttml_lines(df: DataFrame, text: str) -> DataFrame:
    """df with a row for each line of its timed text: line, time_ms, end_ms, voice, line_text, words (time_ms, end_ms, text, background).

    A line without a time begins with its first word; without an end, or a length, it ends with its last. A line without a voice has
    its part's. Words of a background voice are told apart, and aren't part of the line's text. Text that isn't XML has no lines.
    """
    parsed = F.from_xml(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\sttm:", " "), _TIMED, _XML)
    parts = spread(df).withColumn("__div", F.explode(parsed["body"]["div"])).select(*df.columns, F.col("__div._agent").alias("__agent"), F.posexplode("__div.p").alias("__at", "p"))
    ends = lambda x: F.coalesce(time_millis(x["_end"]), time_millis(x["_begin"]) + time_millis(x["_dur"]))
    word = lambda s, back: F.struct(time_millis(s["_begin"]).alias("time_ms"), ends(s).alias("end_ms"), F.coalesce(s["_text"], F.lit("")).alias("text"), back.alias("background"))
    none = F.array().cast("array<struct<time_ms: bigint, end_ms: bigint, text: string, background: boolean>>")
    inner = lambda s: F.coalesce(F.transform(s["span"], lambda t: word(t, F.lit(True))), none)
    is_back = lambda s: F.coalesce(F.endswith(s["_role"], F.lit("x-bg")), F.lit(False))
    spans = F.transform(F.col("p.span"), lambda s: F.when(is_back(s) & (F.size(inner(s)) > 0), inner(s)).otherwise(F.array(word(s, is_back(s)))))
    told = parts.withColumn("words", F.coalesce(F.flatten(spans), none))
    front = F.filter("words", lambda x: ~x["background"])
    said = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(F.col("p._text"), F.lit("")), r"\s+", " ")), F.lit("")), F.array_join(F.transform(front, lambda x: F.trim(x["text"])), " "))
    begin = F.coalesce(time_millis(F.col("p._begin")), F.array_min(F.transform("words", lambda x: x["time_ms"])))
    end = F.coalesce(ends(F.col("p")), F.array_max(F.transform("words", lambda x: x["end_ms"])))
    voice = F.coalesce("p._agent", "__agent")
    lines = told.select(*df.columns, F.col("__at").alias("line"), begin.alias("time_ms"), end.alias("end_ms"), voice.alias("voice"), said.alias("line_text"), "words")
    return lines.filter("time_ms IS NOT NULL")


def webdav_entries(df: DataFrame, text: str) -> DataFrame:
    """df with a row for each entry of its multistatus answer: href, name, folder, size, modified.

    Of an entry's answers the one of status 200 counts. The name is the last part of the path, decoded; a collection is a folder.
    """
    # prefixes differ from server to server, and so do the case of the elements' names not
    parsed = F.from_xml(F.coalesce(text, F.lit("")), _LISTING, _XML)
    each = spread(df).withColumn("r", F.explode(parsed["response"]))
    good = F.get(F.filter("r.propstat", lambda s: F.coalesce(F.contains(s["status"], F.lit(" 200")), F.lit(True))), F.lit(0))
    path = F.regexp_replace(F.trim("r.href"), r"^[a-z][a-z0-9+.-]*://[^/]*|[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    raw = F.coalesce(text, F.lit(""))
    return each.withColumn("s", good).select(
        *df.columns,
        F.trim("r.href").alias("href"),
        F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last).alias("name"),
        (F.col("s.prop.resourcetype.collection").isNotNull() | F.endswith(path, F.lit("/"))).alias("folder"),
        F.col("s.prop.getcontentlength").try_cast("long").alias("size"),
        F.col("s.prop.getlastmodified").alias("modified"),
    ).filter(raw != "")
