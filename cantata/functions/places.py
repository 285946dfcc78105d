"""Where a file lies, and when an event takes place."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantata.functions.text import trimmed

# Zone names that are places in a machine's own setup and not in the world.
ZONES = sorted(zoneinfo.available_timezones() - {"Factory", "localtime"})


def file_location(path: Column, names: dict[str, str] | None = None) -> Column:
    """root, label, folders and file of a stored path, null for what names no file.

    Knows network://host/..., content://provider/... (the last part alone), file:// URLs, shares (// or two backslashes),
    absolute paths, drives, and a path that begins at a volume. ``names``: what to call a network host. A number of a
    track within a file (#track07) isn't part of the name.
    """
    stored = trimmed(F.regexp_replace(F.coalesce(path, F.lit("")), r"#track\d+$", ""))
    scheme = lambda p: F.lower(F.regexp_extract(p, r"^(network|content|file)://", 1))
    plain = lambda p: F.when(scheme(p).isin("network", "content"), p).when(scheme(p) == "file", _decoded(F.regexp_replace(p, "^file://(?:localhost)?", ""))).otherwise(F.replace(p, F.lit("\\"), F.lit("/")))
    return _let(_let(stored, plain), lambda p: _let(_parts(p), lambda at: _location(at, names or {})))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _parts(p: Column) -> Column:
    """kind, root (of a host or drive), and the parts of a path with slashes."""
    remote, drive = p.rlike("^(?:network|content)://"), F.upper(F.regexp_extract(p, "^([A-Za-z]:)(?:/|$)", 1))
    kind = F.when(remote, F.regexp_extract(p, r"^(\w+):", 1)).when(p.startswith("//"), "share").when(p.startswith("/"), "path").when(drive != "", "drive").otherwise("volume")
    host = F.lower(F.regexp_extract(p, r"^\w+://(?:[^/@]*@)?([^/:?#]*)", 1))
    body = F.when(remote, F.regexp_replace(F.regexp_replace(p, r"^\w+://[^/]*", ""), "[?#].*$", "")).when(drive != "", F.substr(p, F.lit(3))).otherwise(p)
    parts = F.transform(F.filter(F.split(body, "/"), lambda x: x != ""), lambda x: F.when(remote, _decoded(x)).otherwise(x))
    return F.struct(kind.alias("kind"), F.when(remote, host).otherwise(drive).alias("base"), parts.alias("parts"))


def _location(at: Column, names: dict[str, str]) -> Column:
    kind, base, parts = at["kind"], at["base"], at["parts"]
    volume, remote = F.get(parts, F.lit(0)), kind.isin("network", "content")
    root = F.when(remote, F.concat(kind, F.lit("://"), base)).when(kind == "share", "//").when(kind == "path", "/").when(kind == "drive", base).otherwise(F.concat(F.lit("volume:"), volume))
    told = F.lit(None).cast("string")
    for host, name in names.items():
        told = F.when(base == host.lower(), name).otherwise(told)
    label = (
        F.when(kind == "network", F.coalesce(told, base)).when(kind == "content", base).when(kind == "share", "\\\\").when(kind == "path", "/")
        .when(kind == "drive", F.concat(base, F.lit("\\"))).otherwise(volume)
    )
    first = F.when(kind == "volume", 2).otherwise(1)
    folders = F.when(kind == "content", F.array().cast("array<string>")).otherwise(F.slice(parts, first, F.greatest(F.size(parts) - first, F.lit(0))))
    found = (F.size(parts) >= first) & (~remote | (base != ""))
    return F.when(found, F.struct(root.alias("root"), label.alias("label"), folders.alias("folders"), F.element_at(parts, -1).alias("file")))


def _decoded(c: Column) -> Column:
    """Percent codes read; what isn't well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def event_time(c: Column, zone: Column) -> Column:
    """at (a timestamp without a zone, the clock at the place) and has_time; null for what isn't a date.

    A day, or a day with a time, with an offset or without. With an offset and a known zone the clock of that zone is given,
    otherwise the clock as written. Days that don't exist are no dates.
    """
    shape = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    groups = [F.regexp_extract(trimmed(c), shape, i + 1).alias(name) for i, name in enumerate(("year", "month", "day", "hour", "minute", "offset"))]
    return _let(_let(F.struct(*groups), _clock), lambda t: F.when(t["wall"].isNotNull(), F.struct(_there(t, trimmed(zone)).alias("at"), t["has_time"].alias("has_time"))))


def _clock(parts: Column) -> Column:
    """wall, the clock as written (null for no date), has_time, and the minutes it is before universal time (null: not told)."""
    number = lambda name: F.coalesce(parts[name].try_cast("int"), F.lit(0))
    exists = (parts["year"] != "") & (number("hour") < 24) & (number("minute") < 60)
    wall = F.when(exists, F.try_make_timestamp_ntz(*map(number, ("year", "month", "day", "hour", "minute")), F.lit(0).cast("decimal(16,6)")))
    digits = F.regexp_replace(parts["offset"], "[Z:]", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    ahead = F.when(parts["offset"] == "", None).when(digits == "", 0).otherwise(F.when(digits.startswith("-"), -minutes).otherwise(minutes))
    return F.struct(wall.alias("wall"), (parts["hour"] != "").alias("has_time"), ahead.alias("ahead"))


def _there(t: Column, zone: Column) -> Column:
    universal = t["wall"] - F.make_dt_interval(F.lit(0), F.lit(0), t["ahead"])
    return F.when(t["ahead"].isNotNull() & zone.isin(*ZONES), F.convert_timezone(F.lit("UTC"), zone, universal)).otherwise(t["wall"])
