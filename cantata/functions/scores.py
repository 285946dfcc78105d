"""Scores of how well a candidate fits what is asked for, as columns; unknown fields count as blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantata.functions.text import credits, isrc, loose_text, lookup_text, simplify_title, token_overlap, trimmed

# The versions of a title that a plain title isn't matched with lightly, and what each costs.
VERSION_MARKS = ("live", "karaoke", "instrumental", "acoustic", "radio edit", "sped up", "slowed")
VERSION_COST = 18

# Letters that no decomposition takes apart.
FOLDED_LETTERS = {"đ": "dj", "ß": "ss", "æ": "ae", "œ": "oe"}


def words_only(c: Column) -> Column:
    """Lower case, letters and digits of any script, a space between runs."""
    return trimmed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def loose_name(c: Column) -> Column:
    """loose_text without accents and with the letters of FOLDED_LETTERS spelled out.

    Accents are taken off Latin-1 and Latin Extended-A letters, which is what names in Latin scripts use; other letters stay.
    """
    plain, bare = _accented()
    text = F.translate(loose_text(c), plain, bare)
    for letter, spelled in FOLDED_LETTERS.items():
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    return text


def _accented() -> tuple[str, str]:
    """Letters up to U+024F that decompose, and what they decompose to without their marks."""
    import unicodedata

    pairs = [(ch, unicodedata.normalize("NFD", ch)[0]) for ch in map(chr, range(0xC0, 0x250))]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def contains_either(a: Column, b: Column) -> Column:
    """Is one in the other? A blank is in nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _points(same: Column, points: int, else_if: Column, half: int) -> Column:
    return F.when(same, points).when(else_if, half).otherwise(0)


def enrichment_score(asked: dict[str, Column], found: dict[str, Column]) -> Column:
    """Of isrc, title, artist: 100 for the code, 30 or 15 for the title, 20 or 10 for the artist, equal or one in the other."""
    code = lambda d: F.upper(trimmed(F.coalesce(d["isrc"], F.lit(""))))
    score = F.when((code(asked) != "") & (code(asked) == code(found)), 100).otherwise(0)
    for field, whole, part in (("title", 30, 15), ("artist", 20, 10)):
        a, b = words_only(asked[field]), words_only(found[field])
        score += _points((a != "") & (a == b), whole, contains_either(a, b), part)
    return score


def share_score(asked: dict[str, Column], found: dict[str, Column], is_collection: Column, album: bool) -> Column:
    """Of name and artists: 25 for a collection, 100 for the name (50 for a part of an album's, 60 of an artist's), 30 for an album's artists."""
    norm = loose_text if album else loose_name
    a, b = norm(asked["name"]), norm(found["name"])
    score = F.when(is_collection, 25).otherwise(0) + _points(a == b, 100, contains_either(a, b), 50 if album else 60)
    if album:
        x, y = loose_name(asked["artists"]), loose_name(found["artists"])
        score += F.when((x != "") & (F.contains(x, y) | F.contains(y, x)), 30).otherwise(0)
    return score


def close_in_time(a: Column, b: Column, seconds: int = 10) -> Column:
    """Durations at most so far apart; an unknown one fits any."""
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return ~known | (F.abs(a - b) <= seconds)


def lyrics_plain(side: dict[str, Column]) -> dict[str, Column]:
    """The side's title and artist as lyrics_score compares them: made once a song or request, not once a pair."""
    first = F.coalesce(F.lower(F.try_element_at(credits(side["artist"]), F.lit(1))), F.lit(""))
    return {"title": simplify_title(side["title"]), "artist": first}


def lyrics_score(asked: dict[str, Column], found: dict[str, Column], plain: bool = False) -> Column:
    """Of title, artist, duration: 50 and 60, half where one contains the other, and 20 for known durations within ten seconds.

    plain: titles and artists are as lyrics_plain makes them already.
    """
    score = F.lit(0)
    x, y = (asked, found) if plain else (lyrics_plain(asked), lyrics_plain(found))
    for field, points in (("title", 50), ("artist", 60)):
        a, b = x[field], y[field]
        score += _points(a == b, points, F.contains(a, b) | F.contains(b, a), points // 2)
    known = (F.coalesce(asked["duration"], F.lit(0)) > 0) & (F.coalesce(found["duration"], F.lit(0)) > 0)
    return score + F.when(known & close_in_time(asked["duration"], found["duration"]), 20).otherwise(0)


def replacement_score(asked: dict[str, Column], found: dict[str, Column]) -> Column:
    """Of isrc, title, artist, album, duration, track, disc, year: how surely a candidate is the same recording.

    Codes that differ, titles and artists that share little, durations far apart and versions not asked for cost points.
    """
    code = lambda d: F.nullif(isrc(d["isrc"]), F.lit(""))
    score = F.when(code(asked).isNull() | code(found).isNull(), 0).when(code(asked) == code(found), 140).otherwise(-120)

    def text(field: str, least: float, whole: int, part: int, none: int) -> Column:
        a, b = words_only(asked[field]), words_only(found[field])
        return F.when(a == b, whole).when(token_overlap(a, b) >= least, part).otherwise(none)

    score += text("title", 0.75, 45, 24, -25) + text("artist", 0.6, 30, 16, -20)
    both_albums = (words_only(asked["album"]) != "") & (words_only(found["album"]) != "")
    score += F.when(both_albums, text("album", 0.7, 12, 6, 0)).otherwise(0)
    apart = F.abs(asked["duration"] - found["duration"])
    known = (F.coalesce(asked["duration"], F.lit(0)) > 0) & (F.coalesce(found["duration"], F.lit(0)) > 0)
    score += F.when(~known, 0).when(apart <= 2, 20).when(apart <= 5, 12).when(apart <= 10, 5).when(apart > 20, -30).otherwise(0)
    for field, points in (("track", 6), ("disc", 4), ("year", 4)):
        score += F.when(asked[field] == found[field], points).otherwise(0)
    for mark in VERSION_MARKS:
        unasked = F.contains(words_only(found["title"]), F.lit(mark)) & ~F.contains(words_only(asked["title"]), F.lit(mark))
        score -= F.when(unasked, VERSION_COST).otherwise(0)
    return score


def catalogue_key(isrc_: Column, public_id: Column, provider: Column, provider_id: Column, name: Column, artists: Column) -> Column:
    """What tells recordings apart: the code, else a public id, else a provider's own, else name and artists."""
    blank = lambda c: F.nullif(trimmed(F.coalesce(c, F.lit(""))), F.lit(""))
    own = F.when(blank(provider).isNotNull() & blank(provider_id).isNotNull(), F.concat_ws(":", blank(provider), blank(provider_id)))
    named = F.concat(trimmed(F.coalesce(name, F.lit(""))), F.lit("|"), trimmed(F.coalesce(artists, F.lit(""))))
    return F.coalesce(F.concat(F.lit("isrc:"), F.upper(blank(isrc_))), F.concat(F.lit("id:"), blank(public_id)), own, named)


def path_aliases(path: Column) -> Column:
    """The ways to write one file's path, in lower case: as it is, without file://, decoded, with / for every slash."""
    raw = trimmed(F.coalesce(path, F.lit("")))
    bare = F.regexp_replace(raw, "(?i)^file://", "")
    valid = ~bare.rlike("%(?![0-9A-Fa-f]{2})") & F.contains(bare, F.lit("%"))
    decoded = F.when(valid, F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(bare)
    forms = F.array(raw, bare, F.coalesce(decoded, bare))
    return F.filter(F.array_distinct(F.transform(forms, lambda p: F.lower(F.replace(p, F.lit("\\"), F.lit("/"))))), lambda p: p != "")


def title_variants(title: Column) -> Column:
    """A title, and without what is in brackets or after a dash, in order, each once."""
    plain = F.regexp_replace(title, r"\s*[\(\[][^\)\]]*[\)\]]", "")
    forms = F.array(title, plain, F.regexp_replace(plain, r"\s+-\s+.*$", ""))
    return F.filter(F.array_distinct(F.transform(forms, lookup_text)), lambda x: x != "")


def artist_variants(artist: Column) -> Column:
    """An artist's line, then each one credited in it."""
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(artist), credits(artist)), lookup_text)), lambda x: x != "")
