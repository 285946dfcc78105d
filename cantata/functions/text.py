"""Scalar functions over text columns: lookup keys, credits, identifiers, titles, clocks, names of files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """'' counts as absent, like NULL."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*map(blank_to_null, columns))


#: All characters that count as white space at the ends of a text.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at its ends; F.trim takes spaces only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lookup_text(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


def optional_text(c: Column) -> Column:
    """Blank and the word null become NULL; the rest is trimmed."""
    t = trimmed(c)
    return F.when((t == "") | (F.lower(t) == "null"), None).otherwise(t)


def truth(c: Column) -> Column:
    """Flags written as true, 1 or yes; other words are false, blanks unknown."""
    t = lookup_text(c)
    return F.when(t == "", None).otherwise(t.isin("true", "1", "yes"))


def match_key(title: Column, artist: Column) -> Column:
    return F.concat_ws("|", lookup_text(title), lookup_text(artist))


def search_text(*columns: Column) -> Column:
    """The fields that are present, in lower case, a space between."""
    return F.concat_ws(" ", *[F.nullif(lookup_text(c), F.lit("")) for c in columns])


def isrc(c: Column) -> Column:
    """Upper case without separators."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def isrc_is_wrong(c: Column) -> Column:
    return (trimmed(F.coalesce(c, F.lit(""))) != "") & (F.length(isrc(c)) != 12)


def isrc_display(c: Column) -> Column:
    v = isrc(c)
    whole = v.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$")
    return F.when(whole, F.concat_ws("-", F.substring(v, 1, 2), F.substring(v, 3, 3), F.substring(v, 6, 2), F.substring(v, 8, 5)))


# What parts one artist of a credit line from the next. A word stands after a space, with a dot or without,
# before a space or the end; JOINING stands between spaces.
CREDIT_MARKS = (",", ";", "&")
FEATURING = ("feat", "feature", "featured", "featuring", "ft")
CREDIT_WORDS = (*FEATURING, "with")
JOINING = "x"


def credits(c: Column) -> Column:
    """A credit line's artists, trimmed, each once whatever its case, the first spelling kept."""
    mark = CREDIT_MARKS[0]
    line = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\s({'|'.join(CREDIT_WORDS)})\.?(?=\s|$)", mark)
    line = F.regexp_replace(line, rf"(?i)\s{JOINING}(?=\s)", mark)
    parts = F.filter(F.transform(F.split(line, "[" + "".join(CREDIT_MARKS) + "]"), lambda p: trimmed(p)), lambda p: p != "")
    return F.filter(parts, lambda p, i: F.array_position(F.transform(parts, lambda q: F.lower(q)), F.lower(p)) == i + 1)


def primary_artist(album_artist: Column, artist: Column) -> Column:
    """The album's artist unless that is blank or various; else the first credit."""
    various = lookup_text(album_artist).isin("", "various", "various artists", "va")
    return F.try_element_at(credits(F.when(various, artist).otherwise(album_artist)), F.lit(1))


# Marks that a title's words are parted by, and the notes that say no more than which edition it is: brackets
# that begin so, whole brackets, and what a dash may be followed by, with a year before it or without.
SPACED_MARKS = r"/\_-|.&+"
EDITION_NOTES, WHOLE_NOTES, DASHED_NOTE = ("feat", "ft", "featuring", "with", "remaster", "deluxe", "bonus", "live", "acoustic"), ("radio edit", "single version"), "remaster"


def loose_text(c: Column) -> Column:
    """Lower case; marks that join words become spaces, others go."""
    spaced = F.regexp_replace(lookup_text(c), rf"[{re.escape(SPACED_MARKS)}\s]+", " ")
    return trimmed(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N} ]", ""), " +", " "))


def simplify_title(c: Column) -> Column:
    """loose_text without notes on the edition; a title that is all marks stays as it is, without the notes."""
    title = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\s*-\s*(?:\d{{4}}\s*)?{DASHED_NOTE}.*$", "")
    title = trimmed(F.regexp_replace(title, rf"(?i)\s*\((?:(?:{'|'.join(EDITION_NOTES)}).*?|{'|'.join(WHOLE_NOTES)})\)", ""))
    return F.coalesce(blank_to_null(loose_text(title)), title)


def contains_words(c: Column, words: Column) -> Column:
    """Do the words occur in sequence, as whole words?"""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(pad(c), pad(words))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts down to 0: edit distance against the longer."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens against the longer list of distinct tokens."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1))
    x, y = tokens(a), tokens(b)
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(longest == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / longest)


def clock_seconds(c: Column) -> Column:
    """h:m:s or m:s to seconds."""
    return F.aggregate(F.split(c, ":"), F.lit(0).cast("long"), lambda total, part: total * 60 + part.try_cast("long"))


def clock(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def release_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")).cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value: each is padded to twenty digits."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def safe_file_name(c: Column, limit: int = 120) -> Column:
    """No reserved characters, no runs of spaces, no dots or spaces at the end, `limit` characters, never empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    t = F.regexp_replace(F.substring(trimmed(t), 1, limit), r"[. ]+$", "")
    return F.when(t == "", "_").otherwise(t)


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """'{artist}/{title}' with the fields' values made safe; an absent field leaves nothing."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        value = fields[name].cast("string")
        out += [F.lit(before), F.when(blank_to_null(trimmed(value)).isNull(), "").otherwise(safe_file_name(value))]
    return F.concat(*out, F.lit(rest))


def url_identity(url: Column) -> Column:
    """Scheme, query, fragment, www. and a slash at the end don't tell pages apart."""
    t = F.regexp_replace(F.lower(trimmed(url)), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"/+$", "")


def gtin_is_valid(c: Column) -> Column:
    """Weights 3 and 1 alternate from the right; the sum with the check digit is a multiple of ten."""
    digits = F.transform(F.split(F.reverse(c), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return F.when(c.rlike(r"^\d{8}$|^\d{12,14}$"), total % 10 == 0).otherwise(F.lit(False))


def djb2(c: Column) -> Column:
    """The 32-bit djb2 hash over UTF-16-free (BMP) text, in lower-case hex."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.lower(F.hex(F.aggregate(codes, F.lit(5381).cast("long"), lambda h, x: (h * 33 + x).bitwiseAND(F.lit(0xFFFFFFFF)))))


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash over a text's code units (of ASCII text), a number."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF)))


def human_bytes(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%d B", n.cast("long"))
    for i in range(1, len(units)):
        out = F.when(n >= 1024**i, F.format_string("%.1f " + units[i], n / float(1024**i))).otherwise(out)
    return out


def guess_script(c: Column) -> Column:
    """The script with the most letters: latin, cyrillic, cjk or none (ties in that order)."""
    counts = [F.regexp_count(c, F.lit(p)) for p in (r"[\p{IsLatin}]", r"[\p{IsCyrillic}]", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")]
    most = F.greatest(*counts)
    return F.when(most == 0, "none").when(counts[0] == most, "latin").when(counts[1] == most, "cyrillic").otherwise("cjk")


def kbps(n: Column) -> Column:
    """A bit rate in thousands, told from one in bits by its size; below 16 it is none."""
    rate = F.when(n >= 10000, F.floor(n / 1000 + 0.5)).otherwise(n)
    return F.when((n > 0) & (rate >= 16), rate).cast("int")


def average_kbps(size: Column, seconds: Column) -> Column:
    """The bit rate that a file's size and length come to."""
    return F.when((size > 0) & (seconds > 0), kbps(F.floor(size * 8 / seconds / 1000 + 0.5)))


def quality_label(depth: Column, rate: Column, bit_rate: Column, format_: Column, stored: Column) -> Column:
    """'FLAC 900kbps' where the bit rate is known, else '24-bit/96kHz', else what is stored."""
    khz = F.when(rate % 1000 == 0, F.format_string("%d", (rate / 1000).cast("int"))).otherwise(F.format_string("%.1f", rate / 1000))
    lossy = F.concat(F.coalesce(F.concat(F.upper(optional_text(format_)), F.lit(" ")), F.lit("")), bit_rate.cast("string"), F.lit("kbps"))
    exact = F.concat(depth.cast("string"), F.lit("-bit/"), khz, F.lit("kHz"))
    return F.when(bit_rate > 0, lossy).when((depth > 0) & (rate > 0), exact).otherwise(optional_text(stored))


# Quality labels that stand for a wish and not for what a file is.
PLACEHOLDER_LABELS = ("best", "lossless", "hi-res", "hi-res-max", "high", "cd")


def is_placeholder_label(c: Column) -> Column:
    return F.coalesce(F.lower(optional_text(c)).isin(*PLACEHOLDER_LABELS), F.lit(False))


# Words that tell a message's level, the first that occurs counts.
LEVEL_WORDS = (
    ("ERROR", ("error", "failed")), ("WARN", ("warning", "warn")), ("INFO", ("success", "match found")), ("DEBUG", ("searching", "trying", "found")),
)


def log_tag(c: Column) -> Column:
    """What stands in brackets at the beginning; null if nothing does."""
    return F.nullif(F.regexp_extract(c, r"^\[([^\]]+)\]", 1), F.lit(""))


def log_level(c: Column) -> Column:
    """ERROR, WARN, INFO or DEBUG, by the words after the tag."""
    text, level = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[[^\]]+\]", "")), F.lit("INFO")
    for name, words in reversed(LEVEL_WORDS):
        level = F.when(text.rlike("|".join(words)), name).otherwise(level)
    return level


def window_offsets(seconds: Column, window: float) -> Column:
    """Where to sample a piece: at 30 and 60 per cent, short ones once in the middle, ones of unknown length at 30 and 90 seconds."""
    end = seconds - window
    two = F.array(F.least(seconds * 0.3, end), F.least(seconds * 0.6, end))
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, F.array(F.lit(30.0), F.lit(90.0))).when(seconds < 2 * window + 6, F.array(F.greatest(F.lit(0.0), end / 2))).otherwise(two)


def catalogue_id(c: Column, scheme: str, host: str, shape: str = "[A-Za-z0-9]{22}") -> Column:
    """The id in a bare id, a URI (scheme:...:id) or a page (https://host/track/id); null in anything else."""
    text = trimmed(F.coalesce(c, F.lit("")))
    bare = F.regexp_extract(text, f"^({shape})$", 1)
    uri = F.regexp_extract(text, rf"^{scheme}:(?:.*:)?\s*({shape})$", 1)
    page = F.regexp_extract(text, rf"^[A-Za-z]+://[^/?#]*{host.replace('.', '[.]')}[^/?#]*/track/({shape})(?:[/?#].*)?$", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (bare, uri, page)])


def shown_progress(status: Column, progress: Column, new_status: Column, new_progress: Column) -> Column:
    """Progress in hundredths; what has ended, or is being finished, doesn't go back."""
    ended = status.isin("completed", "failed", "skipped") | ((status == "finalizing") & (new_status != "finalizing"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), new_progress))
    return F.when(ended, progress).when(new_status == "finalizing", 1.0).when(new_status == "preparing", 0.0).otherwise(F.coalesce(F.round(clamped, 2), progress))
