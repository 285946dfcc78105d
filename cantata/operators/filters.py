"""Predicates with a meaning for what is unknown, and formats under their several names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.functions.text import trimmed

# The names that a format goes by, in tags and as endings of files.
FORMAT_NAMES = {
    "flac": ["flac"], "mp3": ["mp3"], "m4a": ["m4a", "mp4"], "aac": ["aac", "mp4a"], "alac": ["alac"], "opus": ["opus"], "ogg": ["ogg", "vorbis"],
    "wav": ["wav", "wave"], "aiff": ["aiff", "aif", "aifc"], "ape": ["ape"], "wv": ["wv", "wavpack"], "dsf": ["dsf"], "dff": ["dff"],
    "mpc": ["mpc", "musepack"], "eac3": ["eac3", "ec_3"], "ac3": ["ac3", "ac_3"], "ac4": ["ac4", "ac_4"],
}


def has_format(wanted: str, format_: Column, path: Column) -> Column:
    """Is the format tag one of the wanted format's names, or does the path end in one? A name not known stands for itself."""
    wanted = wanted.strip().lower()
    names = FORMAT_NAMES.get(wanted, [wanted])
    tagged = F.lower(F.replace(trimmed(F.coalesce(format_, F.lit(""))), F.lit("-"), F.lit("_"))).isin(names)
    file = F.lower(F.coalesce(path, F.lit("")))
    return reduce(lambda a, b: a | b, [file.endswith(f".{n}") for n in names], tagged)


def confirmed_missing(known: Column, has: Column) -> Column:
    """Looked at and found without; what hasn't been looked at isn't missing."""
    return F.coalesce(known.cast("boolean"), F.lit(False)) & lacks(has)


def lacks(has: Column) -> Column:
    """No, or unknown."""
    return F.coalesce(has.cast("int"), F.lit(0)) == 0


def since(at: Column, cleared: Column) -> Column:
    """Later than the last clearing, or never cleared."""
    return F.coalesce(at > cleared, cleared.isNull())


def not_like(c: Column, pattern: str) -> Column:
    """Doesn't match, whatever the case; nulls don't."""
    return ~F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def released_within(release: Column, today: str, days: int) -> Column:
    """Released in the days up to today; only dates that name the day count."""
    day = F.when(trimmed(release).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(trimmed(release), 1, 10), "yyyy-MM-dd"))
    end = F.to_date(F.lit(today))
    return F.coalesce((day > F.date_sub(end, days)) & (day <= end), F.lit(False))


def unreferenced(rows: DataFrame, key: str, references: DataFrame, foreign: str) -> DataFrame:
    """Rows that nothing refers to: a mirror's files to prune, a cache's orphans."""
    return rows.join(references.select(F.col(foreign).alias(key)), key, "left_anti")
