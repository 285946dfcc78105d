"""Dates as tags write them, and their parts by tokens of a pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantata.functions.text import trimmed

# What a token of a pattern stands for; %% is a per cent sign, any other token stays as it is.
TOKENS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM"}


def tag_date(c: Column) -> Column:
    """The date that a tag's text tells: a moment (its own day, whatever the zone), a date, a month or a year.

    The parts of a date stand between two hyphens, slashes or dots, the same both times; what lacks is the first. If it is none
    of these, its first ten characters may be one, or else its first four digits in a row are the year. Null where there is none.
    """
    raw = trimmed(F.coalesce(c.cast("string"), F.lit("")))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    first = F.lit("01")

    def simple(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, r"^(\d{4})(?:([-/.])(\d{2})(?:(\2)(\d{2}))?)?$", i)
        return F.when(part(1) != "", day(part(1), F.coalesce(F.nullif(part(3), F.lit("")), first), F.coalesce(F.nullif(part(5), F.lit("")), first)))

    moment = raw.rlike(r"^\d{4}-\d{2}-\d{2}T(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[-+](?:[01]\d|2[0-4]):(?:[0-5]\d|60))$")
    prefix = F.when(F.substring(raw, 5, 1) == "-", simple(F.substring(raw, 1, 10)))
    digits = F.regexp_extract(raw, r"(\d{4})", 1)
    year = F.when(~digits.isin("", "0000"), digits)
    return F.coalesce(F.when(moment, day(F.substring(raw, 1, 4), F.substring(raw, 6, 2), F.substring(raw, 9, 2))), simple(raw), prefix, day(year, first, first))


def date_text(c: Column, pattern: str) -> Column:
    """The date that a tag tells, by a pattern with TOKENS; blank where it tells none. Other text of the pattern stays."""
    date = tag_date(c)
    out = []
    for token, text in re.findall(r"(%.)|([^%]+|%$)", pattern, re.DOTALL):
        known = TOKENS.get(token[1:])
        out.append(F.date_format(date, known) if known else F.lit("%" if token == "%%" else token or text))
    return F.when(date.isNull(), "").otherwise(F.concat(*out) if out else F.lit(""))
